"""Merkle manifest of a dataset, with a proof for every leaf by pointer jumping.

* Leaves: SHA-256 of a record's fields, each written as ``-`` if null, else byte count, ``:``, value.
* Tree: within a group (language) leaves ascend by id; as long as a group has several nodes, every ``FANOUT`` consecutive
  ones (the last run may be shorter, even one) become the digest of their digests' hex texts. The one node left is the
  group's subroot; subroots in the order of their groups are joined likewise, up to the root.
* Places: leaves are sorted by range of (group, id), so a group of any size lies in many tasks; a leaf's place in its group
  is its place in its task plus the rows of the group in the tasks before (a table of tasks by groups, summed by a window
  within each group over its tasks).
* Proofs: every node holds an ancestor and the segment of siblings on the way there, at first its parent and its own run's
  others. A round joins the table with itself on that ancestor, which doubles the distance and puts the segments end to
  end, until every node has reached the root: the rounds are the logarithm of the tree's height. The eight leaves of a run
  share all of their way but its first step, so they travel as one row, held by the run's node.
* Verification: a record's present leaf is folded along its segments and compared with the root.

Few nodes near the root are the ancestors of many: the joins are sort-merge joins of two shuffled sides, whose large
partitions adaptive execution splits. Only the rows whose ancestor is not the root yet are joined.

Defined results: null ids come first in their group, a null group before all others; rows with one id are ordered by leaf
digest, so repeated rows have adjacent equal leaves; the only leaf of a group is its subroot and a single subroot is the
root; a leaf without siblings has an empty proof (the digest of the empty text); empty tables give no row; other columns
are ignored. A null id has no decimal form, so its record is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skydelay.llm.common import join_small, shuffle_width
from skydelay.session import cut_lineage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_column(fields: list[Column]) -> Column:
    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return digest(F.concat(*[written(f) for f in fields]))


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within its ``group`` in ascending ``order`` (nulls first), and ``n``, the
    rows of the group. Written sorted to the shared folder; no group is in one task."""
    wide = rows.repartitionByRange(shuffle_width(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranked = cut_lineage(wide.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    here = ranked.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_task = Window.partitionBy("_group").orderBy("_task")
    starts = cut_lineage(here.select("_group", "_task", "_first",
                         (F.sum("_rows").over(by_task) - F.col("_rows")).alias("_before"),
                         F.sum("_rows").over(Window.partitionBy("_group")).alias("n")))
    same = ranked[group].eqNullSafe(F.col("_group")) & (task == F.col("_task"))
    return join_small(ranked, starts, same).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")) \
        .drop("_group", "_task", "_first", "_before", "_at")


def _node(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws("/", tree, F.lit(level).cast("string"), idx.cast("string"))


def _segment(kids: Column, at: Column) -> Column:
    """Siblings of the kid at ``at``: the digests left of it and right of it, as bytes end to end."""
    def side(keep) -> Column:
        return F.aggregate(kids, F.lit(b""), lambda s, k: F.when(keep(k["idx"]), F.concat(s, k["digest"])).otherwise(s))
    return F.struct(side(lambda i: i < at).alias("left"), side(lambda i: i > at).alias("right"))


def hex_digests(run: Column) -> Column:
    """Digest of a run's digests as hex text."""
    return digest(hex_of(F.aggregate(run, F.lit(b""), lambda s, k: F.concat(s, k["digest"]))))


def _raise(level0: DataFrame, start: int, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """From the lowest nodes of trees (tree, node, idx, n: nodes of the tree, digest) to each tree's last node, with the
    pointers (node, anc, seg) of all nodes below. A tree of one node is that node."""
    most = level0.agg(F.max("n").alias("n")).first()["n"] or 0
    tops, pointers, here, level = level0.where("n = 1"), [], level0.where("n > 1"), start
    while most > 1:
        level, most = level + 1, -(-most // fanout)
        up = F.floor(F.col("idx") / fanout)
        runs = cut_lineage(here.groupBy("tree", up.alias("up"))
                           .agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "node"))).alias("kids"), F.first("n").alias("n"))
                           .select("tree", _node(F.col("tree"), level, F.col("up")).alias("node"), F.col("up").alias("idx"),
                                   F.ceil(F.col("n") / fanout).alias("n"), hex_digests(F.col("kids")).alias("digest"), "kids"))
        pointers.append(runs.select(F.col("node").alias("anc"), "kids", F.explode("kids").alias("kid"))
                        .select("kid.node", "anc", F.array(_segment(F.col("kids"), F.col("kid.idx"))).alias("seg")))
        tops = tops.unionByName(runs.where("n = 1").drop("kids"))
        here = runs.where("n > 1").drop("kids")
    return tops, pointers


def jump(pointers: DataFrame, root: str) -> DataFrame:
    """(node, anc, seg) with anc the parent -> with anc the root, by doubling."""
    held = cut_lineage(pointers)
    while not held.where(F.col("anc") != root).isEmpty():
        far = held.select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("seg").alias("more"))
        farther = held.where(F.col("anc") != root).hint("merge").join(far, "anc") \
            .select("node", F.col("far").alias("anc"), F.concat("seg", "more").alias("seg"))
        held = cut_lineage(held.where(F.col("anc") == root).unionByName(farther))
    return held


def fold(leaf: Column, seg: Column) -> Column:
    """The root (hex) that a leaf's digest (bytes) leads to along its segments."""
    return F.aggregate(seg, hex_of(leaf), lambda d, s: F.sha2(F.concat(hex_of(s["left"]), d, hex_of(s["right"])).cast("binary"), 256))


def proofs(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Of records (doc_id, lang, leaf: bytes, present: bytes of the leaf as it is now): doc_id, leaf, subroot, root,
    proof_sha256, folded_root (all hex), verified and seg, the proof itself (an array of left and right siblings as bytes)."""
    spark = records.sparkSession
    # sorting by range reads its input twice; the texts are hashed once
    leaves = placed(cut_lineage(records).withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))), "lang", "doc_id", "leaf", "present")
    up = F.floor(F.col("idx") / fanout)
    kid = F.struct("idx", F.col("leaf").alias("digest"), "doc_id", "present")
    runs = cut_lineage(
        leaves.groupBy("tree", up.alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("leaves"),
                                                   F.first("lang").alias("lang"))
        .select("tree", "lang", _node(F.col("tree"), 1, F.col("up")).alias("node"), F.col("up").alias("idx"),
                F.ceil(F.col("leaves") / fanout).alias("n"), "leaves", "kids",
                F.when(F.col("leaves") == 1, F.col("kids")[0]["digest"]).otherwise(hex_digests(F.col("kids"))).alias("digest")))
    subroots, pointers = _raise(runs.select("tree", "node", "idx", "n", "digest"), 1, fanout)
    langs = runs.where("idx = 0").select("tree", "lang")
    subroots = cut_lineage(subroots.select("tree", "node", "digest").join(langs, "tree"))
    # the trees' subroots are the lowest nodes of one more tree, whose name no group can have
    ranked = placed(subroots.select(F.lit("").alias("tree"), "lang", "node", "digest"), "tree", "lang")
    tops, above = _raise(ranked.drop("lang"), 0, fanout)
    top = tops.first()
    if top is None:
        nothing = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, " \
            "seg array<struct<left: binary, right: binary>>"
        return spark.createDataFrame([], nothing)
    root = top["digest"].hex()
    ways = None
    for p in pointers + above:
        ways = p if ways is None else ways.unionByName(p)
    out = runs.select("tree", "node", "leaves", "kids", F.explode("kids").alias("kid"))
    if ways is None:  # one run is the whole tree
        out = out.withColumn("way", F.array().cast("array<struct<left: binary, right: binary>>"))
    else:
        way = jump(ways, top["node"]).select("node", F.col("seg").alias("way"))
        out = runs.hint("merge").join(way, "node", "left") \
            .select("tree", "leaves", "kids", "way", F.explode("kids").alias("kid"))
    # a group's only leaf is its subroot: it has no run of its own
    own = F.when(F.col("leaves") > 1, F.array(_segment(F.col("kids"), F.col("kid.idx"))))
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    out = out.select("tree", "kid.doc_id", F.col("kid.digest").alias("bytes"), "kid.present",
                     F.concat(F.coalesce(own, none), F.coalesce("way", none)).alias("seg"))
    out = join_small(out, subroots.select("tree", F.col("digest").alias("sub")), "tree")
    siblings = F.aggregate("seg", F.lit(b""), lambda s, x: F.concat(s, x["left"], x["right"]))
    return out.select("doc_id", hex_of(F.col("bytes")).alias("leaf"), hex_of(F.col("sub")).alias("subroot"), F.lit(root).alias("root"),
                      F.sha2(hex_of(siblings).cast("binary"), 256).alias("proof_sha256"),
                      fold(F.col("present"), F.col("seg")).alias("folded_root"), "seg") \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, present: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
             fanout: int = FANOUT) -> DataFrame:
    """``proofs`` of a table's records. ``present`` gives fields as they are at verification, where they may have changed
    since the manifest was made."""
    now = [(present or {}).get(f, F.col(f)) for f in fields]
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_column([F.col(f) for f in fields]).alias("leaf"),
                          leaf_column(now).alias("present"))
    return proofs(records, fanout)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the text of every third id (by crc32) is lower-cased
    before verification."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, {"text": changed}).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(fanout: int = FANOUT) -> str:
    """The same rows in DuckDB SQL: trees by recursion over levels, proofs by walking up a level at a time."""
    def written(field: str) -> str:
        return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({field}::VARCHAR) || ':' || {field}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(written(text if f == 'text' else f) for f in FIELDS)})"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
        lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}))"""
    sides = f"PARTITION BY tree, lvl, idx // {fanout} ORDER BY idx ROWS BETWEEN"
    raise_ = f"""SELECT tree, lvl + 1, idx // {fanout}, (n + {fanout - 1}) // {fanout}, sha256(string_agg(d, '' ORDER BY idx))
        FROM {{0}} WHERE n > 1 GROUP BY tree, lvl, idx // {fanout}, n"""
    steps = f"""SELECT *, coalesce(string_agg(d, '') OVER ({sides} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER ({sides} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {{0}}"""
    climb = f"""SELECT c.doc_id, c.tree, c.lvl + 1, c.idx // {fanout}, c.proof || s.l || s.r, sha256(s.l || c.folded || s.r)
        FROM {{0}} c JOIN {{1}} s USING (tree, lvl, idx) WHERE s.n > 1"""
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, leaf, present,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {leaf('text')} AS leaf,
               CASE WHEN {crc} % 3 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS present FROM documents)),
nodes(tree, lvl, idx, n, d) AS (SELECT tree, 0, idx, n, leaf FROM leaves UNION ALL {raise_.format('nodes')}),
subroots AS (SELECT nodes.tree, nodes.lvl, nodes.d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree) WHERE nodes.n = 1),
tops(tree, lvl, idx, n, d) AS (SELECT '', 0, place, n, d FROM subroots UNION ALL {raise_.format('tops')}),
steps AS ({steps.format('nodes')}), top_steps AS ({steps.format('tops')}),
climb(doc_id, tree, lvl, idx, proof, folded) AS (SELECT doc_id, tree, 0, idx, '', present FROM leaves
  UNION ALL {climb.format('climb', 'steps')}),
top_climb(doc_id, tree, lvl, idx, proof, folded) AS (
  SELECT climb.doc_id, '', 0, place, proof, folded FROM climb JOIN subroots USING (tree, lvl) UNION ALL {climb.format('top_climb', 'top_steps')}),
root AS (SELECT lvl, d FROM tops WHERE n = 1)
SELECT leaves.doc_id, leaves.leaf, subroots.d AS subroot, root.d AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = root.d AS verified
FROM leaves JOIN subroots USING (tree) JOIN top_climb c ON c.doc_id = leaves.doc_id JOIN root ON root.lvl = c.lvl"""
