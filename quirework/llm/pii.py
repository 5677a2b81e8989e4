"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over the whole text and finds anchors: at-signs, URL schemes,
plus signs, digits and identifier cues. A deterministic parser for each kind expands from its anchor
to both sides and checks what it found. Texts without anchors cost one native scan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import batch, text_columns

#: Kinds in the order in which they are listed; the last four come from the method alone.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret", "iban")
BASE = KINDS[:4]

# Characters of an e-mail's local part, and cues of accounts and secrets.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
ACCOUNT_CUES = ("account", "acct", "customer id", "user id", "ssn", "passport")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "api key", "secret")
IBAN_CUES = ("iban",)
#: Characters of an account number by its country code, as the IBAN registry fixes them.
IBAN_LENGTHS = {code: int(n) for n, codes in (
    entry.split(":") for entry in (
        "15:NO", "16:BE", "18:DK FI FO GL NL FK SD", "19:MK SI", "20:AT BA EE KZ LT LU XK MN", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    )
) for code in codes.split()}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REST_OF_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
ACCOUNT_VALUE = re.compile(r"(?:[\x20]?(?i:no|number|nr|id))?\.?[\x20]?[:=#][\x20]?\"?([A-Za-z0-9][A-Za-z0-9-]{4,33})")
SECRET_VALUE = re.compile(r"[\x20]?[:=][\x20]?[\"']?([^\s\"',;]{8,})")
CLOUD_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")
IBAN_VALUE = re.compile(r"[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
Span = tuple[str, int, int]


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors, for texts with A-Z lower-cased; each worker builds it once."""
    a = ahocorasick.Automaton()
    marks = [("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in "0123456789")]
    marks += [(c, "account") for c in ACCOUNT_CUES] + [(c, "secret") for c in SECRET_CUES] + [("akia", "key")] + [(c, "iban") for c in IBAN_CUES]
    for mark, kind in marks:
        a.add_word(mark, (kind, len(mark)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """The check digit rule of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    """The mod-97 rule."""
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the account number from start ends, stop being as far as its characters go; None if no end passes the mod-97 rule.

    What follows a number may look like more of it. A known country fixes the length; where that fails, all of it may still be a
    number. Without a known country the ends are tried from the last to the first.
    """
    ends = [k + 1 for k in range(start, stop) if text[k] != " "]
    fixed = IBAN_LENGTHS.get(text[start : start + 2])
    tried = reversed(ends[14:]) if fixed is None else [*ends[fixed - 1 : fixed], stop]
    return next((e for e in tried if iban_valid(text[start:e])), None)


def find_spans(text: str) -> list[Span]:
    """All spans (kind, start, end) of one text in code points, end exclusive, kinds as listed, then by start.

    Within a kind, spans are leftmost and don't overlap; a match that fails its check is dropped and
    the search goes on behind it.
    """
    spans: list[Span] = []
    end = dict.fromkeys(KINDS, 0)  # where each kind's search goes on
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so positions are the same
    for last, (mark, length) in anchors().iter(lowered):
        at, after = last - length + 1, last + 1
        if mark == "digit":
            if at >= end["ip"]:
                if m := DOTTED.match(text, at):
                    end["ip"] = m.end()
                    if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
                        spans.append(("ip", at, m.end()))
                else:
                    end["ip"] = DIGITS.match(text, at).end()
            if at >= end["card"]:
                if m := CHAIN.match(text, at):
                    end["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, m.end()))
                else:
                    end["card"] = after
        elif mark == "at":
            start, floor = at, end["email"]
            while start > floor and text[start - 1] in LOCAL_PART:
                start -= 1
            if start < at and (m := DOMAIN.match(text, after)):
                end["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif mark == "plus":
            if at >= end["phone"] and (m := DIAL.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif mark == "scheme":
            start, floor = at, end["url"]
            while start > floor and text[start - 1] in SCHEME_PART:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if at - start >= 2 and (m := REST_OF_URL.match(text, after)):
                stop = after + len(m[0].rstrip(".,;:!?)]"))
                if stop > after:
                    end["url"] = m.end()
                    spans.append(("url", start, stop))
        elif mark == "account":
            if after >= end["account"] and (m := ACCOUNT_VALUE.match(text, after)) and any(c.isdigit() for c in m[1]):
                end["account"] = m.end()
                spans.append(("account", m.start(1), m.end(1)))
        elif mark == "secret" or mark == "key" and text.startswith("AKIA", at):
            key = CLOUD_KEY.match(text, at)
            m = None if key else SECRET_VALUE.match(text, after)
            if at >= end["secret"] and (key or m):
                a, b = key.span() if key else m.span(1)
                end["secret"] = b
                spans.append(("secret", a, b))
        elif mark == "iban" and after >= end["iban"] and (m := IBAN_VALUE.match(text, after)) and (stop := iban_end(text, *m.span(1))):
            end["iban"] = stop
            spans.append(("iban", m.start(1), stop))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (order[s[0]], s[1]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, one mark named by the first listed kind."""
    order = {k: n for n, k in enumerate(KINDS)}
    out, at, by_start = [], 0, sorted(spans, key=lambda s: s[1])
    k = 0
    while k < len(by_start):
        kind, a, b = by_start[k]
        k += 1
        while k < len(by_start) and by_start[k][1] < b:
            kind, b = min(kind, by_start[k][0], key=order.get), max(b, by_start[k][2])
            k += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind,start,end>>.

    Null text counts as empty, and empty text has no spans. Null ids and repeated rows are kept as they
    are, each row judged alone. Texts are read whole, however long. Other columns are ignored. An empty
    table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column("text").to_pylist()]
            yield batch(doc_id=b.column("doc_id"), spans=pa.array(found, SPANS))

    return text_columns(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same table with spans in text_col replaced by marks such as <EMAIL>; null stays null, all else is as it was."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, find_spans(t)))

    return docs.withColumn(text_col, mask(docs[text_col]))



def personal_data_digest(docs: DataFrame) -> DataFrame:
    """The spans of personal_data() as the contract's columns: counts, the hash over base spans and all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return personal_data(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
