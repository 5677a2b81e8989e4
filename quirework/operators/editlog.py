"""State from append-only edit logs: truncation, ordered folds, last write wins, time travel.

An edit log has doc_id, seq from 0, kind and nullable payloads. Only the page order depends on the order of all edits; that fold streams the
structural edits of a document through a linked list. All else is grouping by keys with the largest seq, or, for many cursors at once, sorted
unions of edits and cursors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.durable import durable
from quirework.operators.pageorder import PageOrder

STRUCTURAL = ("delete", "move", "insert", "insertImages")
SETTINGS = ("watermark", "numbering", "flattenForms")
FOLD = pa.schema([("doc_id", pa.int64()), ("upto", pa.int64()), ("pages", pa.list_(pa.string())), ("deletes", pa.list_(pa.struct([("page", pa.string()), ("seq", pa.int64())])))])


def effective_edits(log: DataFrame) -> DataFrame:
    """(doc_id, t, cursor): the appended edits that still count; an append at a cursor drops what was undone beyond it."""
    later = Window.partitionBy("doc_id").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    rows = log.withColumn("least", F.min("cursor").over(later))
    return rows.where(F.col("least").isNull() | (F.col("least") > F.col("cursor"))).select("doc_id", "t", "cursor")


def added_pages(edits: DataFrame) -> Column:
    """Ids of the pages that an edit brings in: one for each index of an imported document, or for each picture; null for other kinds."""
    seq = edits["seq"]
    imported = F.transform(edits["indices"], lambda i: F.concat(F.lit("i"), seq.cast("string"), F.lit(":"), edits["asset"], F.lit(":"), i.cast("string")))
    pictures = F.transform(edits["assets"], lambda a, k: F.concat(F.lit("g"), (seq * 1000 + k).cast("string"), F.lit(":"), a))
    return F.when(edits["kind"] == "insert", imported).when(edits["kind"] == "insertImages", pictures)


def inserted_at(page_id: Column) -> Column:
    """The seq of the edit that brought a page in, as its id tells; -1 for original pages."""
    number = F.regexp_extract(page_id, r"^[ig](\d+):", 1).try_cast("long")
    return F.coalesce(F.when(page_id.startswith("i"), number).when(page_id.startswith("g"), F.floor(number / 1000)), F.lit(-1)).cast("long")


def page_order_at(manifest: DataFrame, edits: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc_id, upto, pages, deletes): at each cursor (doc_id, upto) the ordered page ids after the edits before it, and the deletes that took effect.

    manifest has doc_id and pc, the original number of pages o0, o1, ... An insert brings indices of an asset, insertImages a list of
    assets. A missing page or anchor makes a move nothing and an insert go to the end; the last page can't be deleted.
    A document's edits and cursors pass one task once, in their order: it holds the pages of one document, not its edits.
    """
    edit = edits.where(F.col("kind").isin(*STRUCTURAL)).select("doc_id", F.col("seq").alias("at"), F.lit(1).alias("step"), "kind", "page_id", "before_id", added_pages(edits).alias("added"), F.lit(None).cast("long").alias("pc"))
    nothing = [F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("string").alias("before_id"), F.lit(None).cast("array<string>").alias("added")]
    start = manifest.select("doc_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("step"), F.lit("start").alias("kind"), *nothing, F.col("pc").cast("long").alias("pc"))
    stops = cursors.select("doc_id", "upto").distinct().select("doc_id", F.col("upto").cast("long").alias("at"), F.lit(0).alias("step"), F.lit("stop").alias("kind"), *nothing, F.lit(None).cast("long").alias("pc"))
    rows = start.unionByName(edit).unionByName(stops).repartition("doc_id").sortWithinPartitions("doc_id", "at", "step")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, deletes, of = None, [], None
        for b in batches:
            out: list[dict] = []
            for doc, at, _, kind, page, before, added, pc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if doc != of:
                    order, deletes, of = None, [], doc
                if kind == "start":
                    order = PageOrder(f"o{i}" for i in range(pc))
                elif order is None:
                    continue  # not in the manifest
                elif kind == "stop":
                    out.append({"doc_id": doc, "upto": at, "pages": [*order], "deletes": [*deletes]})
                elif order.edit(kind, page, before, added):
                    deletes.append({"page": page, "seq": at})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=FOLD)

    return rows.mapInArrow(fold, "doc_id long, upto long, pages array<string>, deletes array<struct<page:string,seq:bigint>>")


def log_ends(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, upto): a cursor behind the last edit of each document."""
    last = edits.groupBy("doc_id").agg((F.max("seq") + 1).alias("upto"))
    return manifest.select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce("upto", F.lit(0)).alias("upto"))


def page_order_fold(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, pages, deletes): page_order_at() after all edits."""
    return page_order_at(manifest, edits, log_ends(manifest, edits)).select("doc_id", "pages", "deletes")


def final_pages(fold: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ordinal, page_id) of a fold, ordinals from 1."""
    rows = fold.select(*keys, F.posexplode("pages").alias("k", "page_id"))
    return rows.select(*keys, (F.col("k") + 1).alias("ordinal"), "page_id")


def page_attributes(pages: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, page_id, turns, and crop and raster if edits has a payload): quarter turns of each page of a state, modulo 4, and the last crop and raster.

    Pages never come back, so all edits of a present page count that came after it. A null payload is a value: it takes the crop or raster back.
    """
    kinds = ("crop", "raster") if "payload" in edits.columns else ()
    # the kind restricts the order, never the value, so that nulls are kept
    last = [F.max_by(F.struct("payload"), F.when(F.col("kind") == k, F.col("seq")))["payload"].alias(k) for k in kinds]
    on_page = edits.where(F.col("kind").isin("rotate", *kinds) & (F.col("seq") > inserted_at(F.col("page_id"))))
    per = on_page.groupBy(*keys, "page_id").agg(F.sum(F.when(F.col("kind") == "rotate", F.col("turns"))).alias("total"), *last)
    return pages.join(per, [*keys, "page_id"], "left").select(*keys, "page_id", F.pmod(F.coalesce("total", F.lit(0)), F.lit(4)).alias("turns"), *kinds)


def live_marks(edits: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, mark_id, page_id, seq): marks drawn on a page that existed then and is still there, original or inserted, and not erased later.

    pages are those of the state. A deleted page never returns: a mark on one is gone, whether drawn before (removed with it) or after (no page).
    """
    drawn = edits.where((F.col("kind") == "draw") & (F.col("seq") > inserted_at(F.col("page_id")))).select(*keys, "mark_id", "page_id", "seq")
    erased = edits.where("kind = 'erase'").groupBy(*keys, "mark_id").agg(F.max("seq").alias("erased_at"))
    alive = drawn.join(pages.select(*keys, "page_id"), [*keys, "page_id"], "left_semi")
    return alive.join(erased, [*keys, "mark_id"], "left").where("erased_at is null or erased_at < seq").select(*keys, "mark_id", "page_id", "seq")


def field_values_at(edits: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, field, value): the last value written to each field."""
    return edits.where("kind = 'setField'").groupBy(*keys, "field").agg(F.max_by("new_value", "seq").alias("value"))


def metadata_at(edits: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, key, value): the last value of each metadata key; a null takes the key away."""
    last = edits.where("kind = 'metadata'").groupBy(*keys, F.col("field").alias("key")).agg(F.max_by(F.struct("new_value"), "seq")["new_value"].alias("value"))
    return last.where("value is not null")


def document_settings_at(edits: DataFrame, kinds: tuple[str, ...], payload: str = "payload", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, one column for each kind): the payload of the last edit of each kind, such as watermark, numbering and flattening; one pass for all."""
    return edits.groupBy(*keys).agg(*(F.max_by(F.struct(payload), F.when(F.col("kind") == k, F.col("seq")))[payload].alias(k) for k in kinds))


def numbered_cursors(edits: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc_id, cursor, upto, epoch): cursors held within the log, and their number among the document's cursors; equal positions share one number."""
    n = edits.groupBy("doc_id").agg(F.count("*").alias("n"))
    upto = F.least(F.greatest("cursor", F.lit(0)), F.coalesce("n", F.lit(0)))
    return cursors.select("doc_id", "cursor").distinct().join(n, "doc_id", "left").select("doc_id", "cursor", upto.alias("upto")).withColumn("epoch", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("upto")))


def with_epochs(edits: DataFrame, cursors: DataFrame) -> DataFrame:
    """Edits with their epoch, the number of the first cursor that sees them; edits behind the last cursor are left out.

    An as-of join by one sorted union: cursors, then edits in the order of their places, with a running count of the cursors passed.
    """
    stops = cursors.groupBy("doc_id", "upto").agg(F.lit(True).alias("stop")).select("doc_id", F.col("upto").alias("seq"), "stop")
    both = edits.withColumn("stop", F.lit(False)).unionByName(stops, allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id").orderBy("seq", F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id")
    passed = both.withColumn("epoch", F.count_if("stop").over(so_far) + 1).withColumn("epochs", F.count_if("stop").over(whole))
    return passed.where("not stop and epoch <= epochs").drop("stop")


def last_by_epoch(edits: DataFrame, key: Column, value: str) -> DataFrame:
    """(doc_id, epoch, key, value): at each cursor the last value of each key that has one, nulls included.

    Of the edits of one epoch only the last is kept; its value holds for the cursors from its epoch to the key's next one.
    """
    per = edits.groupBy("doc_id", "epochs", key.alias("key"), "epoch").agg(F.max_by(F.struct(value), "seq")[value].alias("value"))
    until = F.coalesce(F.lead("epoch").over(Window.partitionBy("doc_id", "key").orderBy("epoch")) - 1, "epochs")
    return per.withColumn("until", until).withColumn("epoch", F.explode(F.sequence("epoch", "until"))).select("doc_id", "epoch", "key", "value")


def attributes_at(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, epoch, page_id, turns, crop, raster) of the pages (doc_id, epoch, page_id) of each cursor, as page_attributes() has them.

    Pages and edits of one page in one sorted union: turns are a running sum, crop and raster the last before the cursor.
    """
    kinds = ("crop", "raster")
    own = edits.where(F.col("kind").isin("rotate", *kinds) & (F.col("seq") > inserted_at(F.col("page_id"))))
    last = [F.when(F.col("kind") == k, F.struct("payload")).alias(k) for k in kinds]
    changes = own.select("doc_id", "page_id", "epoch", "seq", F.when(F.col("kind") == "rotate", F.col("turns")).alias("turn"), *last, F.lit(False).alias("shown"))
    both = changes.unionByName(pages.select("doc_id", "page_id", "epoch", F.lit(True).alias("shown")), allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id", "page_id").orderBy("epoch", "shown", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("doc_id", "epoch", "page_id", "shown", F.sum("turn").over(so_far).alias("total"), *(F.last(k, ignorenulls=True).over(so_far)["payload"].alias(k) for k in kinds))
    return seen.where("shown").select("doc_id", "epoch", "page_id", F.pmod(F.coalesce("total", F.lit(0)), F.lit(4)).alias("turns"), *kinds)


def marks_at(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, epoch, mark_id, page_id, seq) of the marks that live_marks() has at each cursor; pages are (doc_id, epoch, page_id)."""
    own = edits.where((F.col("kind") == "erase") | (F.col("kind") == "draw") & (F.col("seq") > inserted_at(F.col("page_id"))))
    later = Window.partitionBy("doc_id", "mark_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    drawn = own.withColumn("erased", F.min(F.when(F.col("kind") == "erase", F.col("epoch"))).over(later)).where("kind = 'draw'")
    until = F.coalesce(F.col("erased") - 1, "epochs")
    shown = drawn.where(until >= F.col("epoch")).withColumn("epoch", F.explode(F.sequence("epoch", until)))
    return shown.join(pages.select("doc_id", "epoch", "page_id"), ["doc_id", "epoch", "page_id"], "left_semi").select("doc_id", "epoch", "mark_id", "page_id", "seq")


def whole_state(manifest: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Pages, attributes, marks, fields, metadata and settings after all edits of each document."""
    pages = final_pages(page_order_fold(manifest, edits))
    return {
        "pages": pages,
        "attributes": page_attributes(pages, edits),
        "marks": live_marks(edits, pages),
        "fields": field_values_at(edits),
        "metadata": metadata_at(edits),
        "settings": document_settings_at(edits, SETTINGS),
    }


def state_at(manifest: DataFrame, edits: DataFrame, cursors: DataFrame) -> dict[str, DataFrame]:
    """The whole state of every asked (doc_id, cursor), which depends on the edits before the cursor only.

    Edits are sent once, with the number of the first cursor that sees them, and all page orders come out of one fold. Rows grow with
    the edits, the cursors and what the states hold. cursors may repeat and lie outside the log.
    """
    known = durable(numbered_cursors(edits, cursors.join(manifest.select("doc_id"), "doc_id", "left_semi")))
    seen = durable(with_epochs(edits, known))
    orders = page_order_at(manifest, seen, known).join(known.select("doc_id", "upto", "epoch").distinct(), ["doc_id", "upto"])
    pages = durable(final_pages(orders, ("doc_id", "epoch")))
    kind = F.col("kind")
    settings = last_by_epoch(seen.where(kind.isin(*SETTINGS)), kind, "payload").groupBy("doc_id", "epoch").agg(*(F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in SETTINGS))
    parts = {
        "pages": pages,
        "attributes": attributes_at(pages, seen),
        "marks": marks_at(seen, pages),
        "fields": last_by_epoch(seen.where(kind == "setField"), F.col("field"), "new_value").withColumnRenamed("key", "field"),
        "metadata": last_by_epoch(seen.where(kind == "metadata"), F.col("field"), "new_value").where("value is not null"),
        "settings": settings,
    }
    return {name: known.select("doc_id", "cursor", "epoch").join(df, ["doc_id", "epoch"]).drop("epoch") for name, df in parts.items()}


def untouched_documents(manifest: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """(doc_id): documents whose pages are the original ones, unturned and uncropped, with no marks, fields, metadata or settings."""
    pages = state["pages"].join(state["attributes"], ["doc_id", "page_id"])
    plain = (F.col("turns") == 0) & F.col("crop").isNull() & F.col("raster").isNull()
    same = pages.groupBy("doc_id").agg(F.bool_and((F.col("page_id") == F.concat(F.lit("o"), (F.col("ordinal") - 1).cast("string"))) & plain).alias("same"), F.count("*").alias("n"))
    rows = manifest.join(same, "doc_id").where("same and n = pc").select("doc_id")
    asked = state["settings"].where(F.coalesce(*SETTINGS).isNotNull())
    for part in (state["marks"], state["fields"], state["metadata"], asked):
        rows = rows.join(part, "doc_id", "left_anti")
    return rows


def referenced_assets(assets: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, orphans): assets that some edit still refers to, undone ones included, and the others."""
    used = references.select("asset").where("asset is not null").distinct()
    return assets.join(used, "asset", "left_semi"), assets.join(used, "asset", "left_anti")


def live_import_notes(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes on an import of which the document still has a page."""
    return notes.join(pages.where("asset is not null").select("doc_id", "asset"), ["doc_id", "asset"], "left_semi")


def page_signatures(state: dict[str, DataFrame], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ordinal, page_id, signature) of what a page shows: id, turns, crop and raster if known, and its marks in order."""
    marks = state["marks"].groupBy(*keys, "page_id").agg(F.array_join(F.array_sort(F.collect_list("mark_id")), ",").alias("m"))
    shows = state["attributes"].distinct()  # an import that names an index twice gives two pages of one id
    rows = state["pages"].join(shows, [*keys, "page_id"]).join(marks, [*keys, "page_id"], "left")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in state["attributes"].columns if c not in (*keys, "page_id")]
    return rows.select(*keys, "ordinal", "page_id", F.sha2(F.concat_ws("|", "page_id", *shown, F.coalesce("m", F.lit(""))), 256).alias("signature"))


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, page_id, change): pages added, removed or shown differently between two states' signatures; equal ids count once."""
    b, a = (side.select("doc_id", "page_id", F.col("signature").alias(name)).distinct() for side, name in ((before, "was"), (after, "now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return b.join(a, ["doc_id", "page_id"], "full").select("doc_id", "page_id", change.alias("change")).where("change is not null")


def resumable_sessions(sessions: DataFrame, shape: int) -> DataFrame:
    """The latest session of each key among those that are complete and of the current shape."""
    order = Window.partitionBy("session_key").orderBy(F.col("saved_at").desc(), F.col("event_id").desc())
    return sessions.where((F.col("shape") == shape) & F.col("complete")).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def effective_values(originals: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, field, effective, patch): a session's value over the document's own; a patch equal to the original is null."""
    met = originals.join(values.select("doc_id", "field", F.col("value").alias("new")), ["doc_id", "field"], "left")
    return met.select("doc_id", "field", F.coalesce("new", "value").alias("effective"), F.nullif("new", "value").alias("patch"))
