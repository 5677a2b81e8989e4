"""What documents carry: reachability, live fields and bookmarks, attachments, and what a change lost.

Graphs are edge tables. Searches run as joins of a frontier, with chains followed by pointer doubling; bounded descents take one round for each
level. They end when no new node is met or at the bound of the operator; each round is written to the shared folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.durable import durable

CATEGORIES = ("form", "bookmarks", "attachments", "page_labels", "layers", "accessibility", "metadata_title", "language")
# The categories whose survival can be vouched for, and those that belong to a document and not to its pages.
VERIFIABLE = ("form", "bookmarks", "attachments", "page_labels", "metadata_title", "language")
DOCUMENT_LEVEL = ("metadata_title", "language")
FIELD_DEPTH, NAME_DEPTH, HOPS, ATTACHMENT_DEPTH = 16, 16, 8, 8


def main_targets(edges: DataFrame) -> DataFrame:
    """(src, dst): at most one edge of each node, on which chains of nodes are followed.

    Targets without edges of their own end a walk and don't count. Of the others a node's only one is taken, or else the least that comes
    after the node in the order of the names, as lists are numbered from one end. Any choice gives the same objects; a good one saves rounds.
    """
    open_ends = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    after = F.min(F.when(F.col("dst") > F.col("src"), F.col("dst")))
    per = open_ends.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("least"), after.alias("after"))
    return per.select("src", F.when(F.col("n") == 1, F.col("least")).otherwise(F.col("after")).alias("dst")).where("dst is not null")


def path_places(chains: DataFrame) -> DataFrame:
    """(node, path, left): the path that each node of the chains is on, and the steps from there to its end.

    Chains have one edge a node at most; where several lead to one node, one of them goes on as the path. Pointer doubling, two doublings a
    round: each node knows a node further on, how far that is, and the least node passed. A cycle is a path of its own, named by its least
    node, on which every node reaches all others, so that left is 0.
    """
    on = chains.groupBy("dst").agg(F.min("src").alias("src"))
    ends = on.select(F.col("dst").alias("node")).join(on.select(F.col("src").alias("node")), "node", "left_anti")
    step = on.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("left"), F.least("src", "dst").alias("least"), F.lit(False).alias("ended"))
    known = durable(step.unionByName(ends.select("node", F.col("node").alias("to"), F.lit(0).cast("long").alias("left"), F.col("node").alias("least"), F.lit(True).alias("ended"))))

    def further(df: DataFrame) -> DataFrame:
        ahead = df.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        return df.join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("left") + F.col("_left")).alias("left"), F.least("least", "_least").alias("least"), F.col("_ended").alias("ended"))

    n, reach = known.count(), 1
    while reach < n and not known.where("not ended").isEmpty():
        known, reach = durable(further(further(known))), 4 * reach
    return known.select("node", F.when(F.col("ended"), F.col("to")).otherwise(F.col("least")).alias("path"), F.when(F.col("ended"), F.col("left")).otherwise(F.lit(0)).alias("left"))


def along(frontier: DataFrame, places: DataFrame) -> DataFrame:
    """(node): the frontier and all that lies on its paths from there on."""
    far = frontier.join(places, "node").groupBy("path").agg(F.max("left").alias("_left"))
    return frontier.unionByName(places.join(far, "path").where(F.col("left") <= F.col("_left")).select("node")).distinct()


#: Rounds of plain search before chains are looked for; tables of reached nodes that are read side by side before they are written as one.
PLAIN_ROUNDS, PIECES = 4, 8


def reachable_objects(edges: DataFrame, roots: DataFrame, barriers: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(node): what is reached from the roots over edges (src, dst) without entering a barrier; cycles are met once.

    Where a search isn't over after a few rounds, chains (edges of which each node has one at most; if not given, main_targets()) of the nodes not yet
    reached are numbered by pointer doubling, in rounds that grow with the logarithm of their length, and each is then passed in one round. All other
    edges take one round for each that a way has, so rounds grow with branching depth.
    """
    off = barriers.select(F.col("node").alias("dst"))
    allowed = edges.select("src", "dst").join(off, "dst", "left_anti")
    frontier = durable(roots.select("node").distinct().join(barriers, "node", "left_anti"))
    pieces, places, rounds = [frontier], None, 0
    while not frontier.isEmpty():
        seen = functools.reduce(DataFrame.unionByName, pieces)
        step = allowed.join(frontier, allowed["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = durable(step.join(seen, "node", "left_anti"))
        if rounds >= PLAIN_ROUNDS and not frontier.isEmpty():
            if places is None:
                unseen = lambda df: df.join(seen.select(F.col("node").alias("src")), "src", "left_anti")  # noqa: E731, B023
                places = path_places(main_targets(unseen(allowed)) if chains is None else unseen(chains.select("src", "dst").join(off, "dst", "left_anti")))
            frontier = durable(along(frontier, places).join(seen, "node", "left_anti"))
        pieces.append(frontier)
        rounds += 1
        if len(pieces) > PIECES:
            pieces = [durable(functools.reduce(DataFrame.unionByName, pieces))]
    return functools.reduce(DataFrame.unionByName, pieces)


def unreachable_objects(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """(node): the objects to delete; barriers are among them."""
    return objects.select("node").join(reachable, "node", "left_anti")


def descend(starts: DataFrame, kids: DataFrame, depth: int, open_node: Column | None = None) -> DataFrame:
    """(top, node, path): starts (top, node) and their descendants over kids (node, pos, kid), down to `depth` levels.

    path has the positions from the top, so that its order is the order of a walk. open_node says which nodes are gone into.
    """
    level = starts.select("top", "node", F.array().cast("array<bigint>").alias("path"))
    found = level = durable(level)
    for _ in range(depth):
        into = level if open_node is None else level.where(open_node)
        level = durable(into.join(kids, "node").select("top", F.col("kid").alias("node"), F.array_append("path", F.col("pos")).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def live_fields(tops: DataFrame, kids: DataFrame, live_widgets: DataFrame) -> DataFrame:
    """(top): top-level fields that are, or have among their descendants, a widget on a live page."""
    nodes = descend(tops.select(F.col("node").alias("top"), "node"), kids, FIELD_DEPTH)
    return nodes.join(live_widgets.select("node"), "node", "left_semi").select("top").distinct()


def name_tree_entries(tops: DataFrame, kids: DataFrame, names: DataFrame, legacy: DataFrame) -> DataFrame:
    """(top, key, value): entries of name trees; of a repeated key the one met last in the walk counts, and the legacy dictionary over the tree.

    names is (node, pos, key, value); a node's own names come before its kids'.
    """
    nodes = descend(tops.select(F.col("node").alias("top"), "node"), kids, NAME_DEPTH)
    entries = nodes.join(names, "node").select("top", "key", "value", F.struct("path", "pos").alias("at"))
    tree = entries.groupBy("top", "key").agg(F.max_by("value", "at").alias("tree_value"))
    both = tree.join(legacy.select("top", "key", F.col("value").alias("legacy_value")), ["top", "key"], "full")
    return both.select("top", "key", F.coalesce("legacy_value", "tree_value").alias("value"))


def resolve_destinations(dests: DataFrame, objects: DataFrame) -> DataFrame:
    """(dest, page): the page that each destination leads to over named and wrapped ones; null if it isn't met within eight hops.

    objects is (obj, kind, ref): an array's ref is its page, any other's the object that it leads to.
    """
    now = dests.select("dest", F.col("obj").alias("at"), F.lit(None).cast("string").alias("page")).distinct()
    o = objects.select("obj", "kind", "ref")
    for _ in range(HOPS + 1):
        met = now.join(o, now["at"] == o["obj"], "left")
        is_array = F.col("kind") == "array"
        now = met.select("dest", F.when(~is_array, F.col("ref")).alias("at"), F.coalesce("page", F.when(is_array, F.col("ref"))).alias("page"))
    return now.select("dest", "page")


def live_bookmarks(items: DataFrame, links: DataFrame, roots: DataFrame, resolved: DataFrame, live_pages: DataFrame) -> DataFrame:
    """(node, page): outline items, of all levels, whose destination or else whose action leads to a live page.

    items is (node, dest, action_dest), links (node, first_child, next_node). Siblings are chains: rounds grow with the levels of the outline
    and the logarithm of the longest list of siblings.
    """
    nobody = roots.where("false")
    following = links.where("next_node is not null").select(F.col("node").alias("src"), F.col("next_node").alias("dst"))
    edges = links.where("first_child is not null").select(F.col("node").alias("src"), F.col("first_child").alias("dst")).unionByName(following)
    met = items.join(reachable_objects(edges, roots, nobody, following), "node", "left_semi")
    by = lambda name: resolved.select(F.col("dest").alias(name), F.col("page").alias(f"{name}_page"))
    pages = met.join(by("dest"), "dest", "left").join(by("action_dest"), "action_dest", "left").select("node", F.coalesce("dest_page", "action_dest_page").alias("page"))
    return pages.join(live_pages.select("page"), "page", "left_semi").select("node", "page")


def attachment_counts(tops: DataFrame, kids: DataFrame, sizes: DataFrame) -> DataFrame:
    """(top, attachments): files of each tree; a node with names hides its kids. sizes is (node, n), n the length of its name array."""
    named = sizes.select(F.col("node").alias("_n"))
    open_kids = kids.join(named, kids["node"] == named["_n"], "left_anti")
    nodes = descend(tops.select(F.col("node").alias("top"), "node"), open_kids, ATTACHMENT_DEPTH)
    return nodes.join(sizes, "node", "left").groupBy("top").agg(F.sum(F.floor(F.coalesce("n", F.lit(0)) / 2)).cast("long").alias("attachments"))


def structure_summary(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per document: its page_count and a column for each category; what isn't counted, as in unreadable documents, is 0.

    docs is (doc_id, page_count), facts (doc_id, category, n).
    """
    wide = facts.groupBy("doc_id").pivot("category", list(CATEGORIES)).agg(F.sum("n"))
    return docs.select("doc_id", "page_count").join(wide, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in CATEGORIES))


def _long(summary: DataFrame, name: str, key: str) -> DataFrame:
    return summary.unpivot([key], list(CATEGORIES), "category", name)


def structure_diff(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category, before, after): categories that were there and are fewer now."""
    return _long(before, "before", key).join(_long(after, "after", key), [key, "category"]).where("before > 0 and after < before")


def structure_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, present, losses): categories that can be vouched for, and what was lost, as texts in the order of the names."""
    present = _long(before, "n", "doc_id").where(F.col("category").isin(*VERIFIABLE) & (F.col("n") > 0)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("present"))
    line = F.format_string("%s:%d>%d", "category", "before", "after")
    losses = structure_diff(before, after).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("losses"))
    return before.select("doc_id").join(present, "doc_id", "left").join(losses, "doc_id", "left").select("doc_id", F.coalesce("present", F.lit("")).alias("present"), F.coalesce("losses", F.lit("")).alias("losses"))


def merge_structure_losses(summaries: DataFrame, merged: DataFrame) -> DataFrame:
    """(batch_id, category, before, after): what merged documents have less of than their inputs together."""
    together = summaries.groupBy("batch_id").agg(*(F.sum(c).alias(c) for c in CATEGORIES))
    return structure_diff(together, merged, "batch_id")


def import_losses(summaries: DataFrame) -> DataFrame:
    """(doc_id, category, n): structures that imported pages can't bring along."""
    kinds = [c for c in VERIFIABLE if c not in DOCUMENT_LEVEL]
    return _long(summaries, "n", "doc_id").where(F.col("category").isin(*kinds) & (F.col("n") > 0))


def orphan_widgets(annots: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): form controls on imported pages go, as their form didn't come; other annotations stay."""
    keys = ["doc_id", "page_id"]
    on_import = annots.join(imported.select(*keys).distinct(), keys, "left_semi")
    dropped = on_import.where("subtype = 'Widget'")
    kept = annots.join(imported.select(*keys).distinct(), keys, "left_anti").unionByName(on_import.where("subtype <> 'Widget'"))
    return kept, dropped


def strip_redacted_fields(widgets: DataFrame, stripped: DataFrame) -> DataFrame:
    """(field, action): a field whose widgets are all on redacted pages is removed; one with some of them there loses those."""
    hit = widgets.join(stripped.select("widget").distinct().withColumn("hit", F.lit(True)), "widget", "left").select("field", F.coalesce("hit", F.lit(False)).alias("hit"))
    per = hit.groupBy("field").agg(F.bool_and("hit").alias("whole"), F.bool_or("hit").alias("some"))
    return per.select("field", F.when(F.col("whole"), "remove").when(F.col("some"), "lose-widgets").otherwise("keep").alias("action"))
