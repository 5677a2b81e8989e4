"""Registry of office formats, per-tool limits and the characters that standard fonts can encode."""

from __future__ import annotations

# Extensions of each family, the export filter of each family, and the legacy ones.
PRESENTATION = (".pptx", ".ppsx", ".pptm", ".ppsm", ".potx", ".ppt", ".pps", ".odp", ".fodp")
DOCUMENT = (".docx", ".docm", ".dotx", ".doc", ".odt", ".fodt", ".rtf")
SPREADSHEET = (".xlsx", ".xlsm", ".xltx", ".xls", ".ods", ".fods")
DRAWING = (".odg",)
FILTERS = {"presentation": "impress_pdf_Export", "document": "writer_pdf_Export", "spreadsheet": "calc_pdf_Export", "drawing": "draw_pdf_Export"}
LEGACY = (".ppt", ".pps", ".doc", ".xls")

FAMILIES = {"presentation": PRESENTATION, "document": DOCUMENT, "spreadsheet": SPREADSHEET, "drawing": DRAWING}
EXTENSIONS = [e for group in FAMILIES.values() for e in group]
#: Rows (extension, filter, family, legacy).
FORMATS = [(e, FILTERS[family], family, e in LEGACY) for family, group in FAMILIES.items() for e in group]

MIB = 1024 * 1024
# Ceilings in bytes and pages.
MAX_FILE_BYTES = 150 * MIB
MAX_STRUCTURAL_BYTES = 400 * MIB
MAX_RENDERED_PAGES = 500
MAX_OCR_PAGES = 500
MAX_BATCH_OUTPUT_BYTES = 300 * MIB
#: Rows (tool, max_bytes, max_pages); no page ceiling is null.
LIMITS = [("split", MAX_STRUCTURAL_BYTES, None), ("merge", MAX_STRUCTURAL_BYTES, None), ("compress", MAX_FILE_BYTES, MAX_RENDERED_PAGES), ("ocr", MAX_FILE_BYTES, MAX_OCR_PAGES)]

# Characters that the standard fonts encode, as the inside of a character class.
WIN_ANSI = " -~\u00a0-\u00ff" + "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
