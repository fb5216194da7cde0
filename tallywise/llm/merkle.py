"""A Merkle manifest of a dataset, with an inclusion proof for every row by pointer jumping.

Every row is a leaf: the SHA-256 of its fields, each with its length.  Leaves of a group stand in the order of their ids;
every ``fanout`` consecutive ones become a node, and so on up to the group's root.  The roots of the groups, in the order
of the groups, make the root of the dataset in the same way.

A node holds the segment of siblings on the way towards an ancestor, at first its parent.  A self-join of the nodes
appends to each segment that of the ancestor and doubles the distance; after about log2(height) joins all segments reach the root.
Only the inner nodes, a seventh as many as leaves, take part in these joins; the leaves of a run take its segment at the end.
Ancestors high up are wanted by many nodes but are few themselves, so they are broadcast while they are at most ``BROADCAST``.

Ranks come from a range sort with the sums of its parts, so no task sees a whole group.  Null groups come first; a null id
comes before others; rows that repeat an id are leaves each, in the order of their digests.  Empty tables give empty
results.  Very long texts are hashed where they are read, and only digests travel.  Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.operators.order import positions
from tallywise.sources.staging import staged
from tallywise.tables import small

FANOUT = 8
#: Ancestors are broadcast up to this number in a join (some KB each); beyond it they are shuffled.
BROADCAST = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in hex of the fields in a row: ``-`` for null, else the bytes of the text, a colon and the text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings ``array<struct<left, right>>`` give."""
    return F.aggregate(proof, leaf, lambda h, e: F.sha2(F.concat(e["left"], h, e["right"]), 256))


def siblings_text(proof: Column) -> Column:
    """All siblings of a proof in a row, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda e: F.concat(e["left"], e["right"])), "")


def _beside(hashes: Column, i: Column) -> Column:
    """The siblings before and after the entry at ``i``."""
    cut = lambda start, n: F.array_join(F.slice(hashes, start, n), "")
    return F.struct(cut(F.lit(1), i).alias("left"), cut(i + 2, F.greatest(F.size(hashes) - i - 1, F.lit(0))).alias("right"))


def _name(tree: Column, level: int, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), F.lit(level).alias("level"), idx.alias("idx"))


def _grown(nodes: DataFrame, level: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of all nodes up to the tops of their trees, and these tops (tree, node, h).

    ``nodes`` (tree, idx, n, h) stand on ``level``; n is the number of nodes of the tree there.
    """
    links, tops = [], None
    while True:
        own = nodes.filter("n = 1").select("tree", _name(F.col("tree"), level, F.col("idx")).alias("node"), "h")
        tops = own if tops is None else tops.unionByName(own)
        more = nodes.filter("n > 1")
        if more.isEmpty():
            return links, tops
        up = (F.col("idx") / fanout).cast("long")
        members = F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda e: e["h"])
        run = staged(more.groupBy("tree", "n", up.alias("up")).agg(members.alias("hashes")))
        each = run.select("tree", "up", "hashes", F.posexplode("hashes").alias("i", "h"))
        links.append(each.select(_name(F.col("tree"), level, F.col("up") * fanout + F.col("i")).alias("node"), _name(F.col("tree"), level + 1, F.col("up")).alias("to"), F.array(_beside(F.col("hashes"), F.col("i"))).alias("proof")))
        level += 1
        nodes = run.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("hashes", ""), 256).alias("h"))


def _jumped(links: DataFrame) -> DataFrame:
    """(node, proof): the siblings from each node up to the root, by doubling distances."""
    now, distance = staged(links), 1
    while True:
        open_ = now.filter("to IS NOT NULL")
        if open_.isEmpty():
            return now
        far = small(now.filter(F.col("node.level") >= distance).select(F.col("node").alias("at"), F.col("to").alias("next"), F.col("proof").alias("rest")), BROADCAST)
        met = open_.join(far, F.col("to") == F.col("at"), "left")
        longer = met.select("node", F.col("next").alias("to"), F.when(F.col("rest").isNull(), F.col("proof")).otherwise(F.concat("proof", "rest")).alias("proof"))
        now, distance = staged(longer.unionByName(now.filter("to IS NULL"))), distance * 2


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof (array of struct<left, right>, from the leaf to the root).

    ``carry`` adds columns of ``docs`` by name.
    """
    carry = carry or {}
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    leaves = docs.select(group.alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*[F.col(c) for c in fields]).alias("leaf"), *[v.alias(f"c_{k}") for k, v in carry.items()])
    # the number of the row parts equal rows, so that no range is longer for them
    leaves = staged(leaves.withColumn("row", F.monotonically_increasing_id()))
    placed = positions(leaves, ["doc_id", "leaf", "row"], ["tree"])
    up = (F.col("pos") / fanout).cast("long")
    bottom = placed.groupBy("tree", "n", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", *[f"c_{k}" for k in carry]))).alias("members"))
    bottom = staged(bottom.withColumn("hashes", F.transform("members", lambda m: m["leaf"])))

    alone = bottom.filter("n = 1").select("tree", F.lit(0).cast("long").alias("idx"), "n", F.col("hashes")[0].alias("h"))
    first = bottom.filter("n > 1").select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("hashes", ""), 256).alias("h"))
    links, tops = _grown(first, 1, fanout)
    subroots = staged(tops.unionByName(alone.select("tree", _name(F.col("tree"), 0, F.col("idx")).alias("node"), "h")))
    # the groups' roots are the leaves of the tree above; its levels are counted from above all of theirs
    height = len(links) + 1
    placed_roots = staged(positions(subroots, ["tree"]))
    above = placed_roots.select(F.lit("").alias("tree"), F.col("pos").alias("idx"), "n", "h")
    top_links, root = _grown(above, height, fanout)
    if top_links:
        renamed = placed_roots.select("node", _name(F.lit(""), height, F.col("pos")).alias("as"))
        first_up = top_links[0].withColumnRenamed("node", "as").join(small(renamed), "as").select("node", "to", "proof")
        links = [*links, first_up, *top_links[1:]]
    rows = bottom.withColumn("node", F.when(F.col("n") == 1, _name(F.col("tree"), 0, F.col("up"))).otherwise(_name(F.col("tree"), 1, F.col("up"))))
    if links:
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        paths = _jumped(every).select(F.col("node").alias("at"), F.col("proof").alias("path"))
        rows = rows.join(paths.hint("merge"), F.col("node") == F.col("at"), "left")
    else:
        rows = rows.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    found = root.first()
    rows = rows.join(small(subroots.select("tree", F.col("h").alias("subroot"))), "tree")
    each = rows.select("n", "hashes", "path", "subroot", F.posexplode("members").alias("i", "m"))
    rest = F.coalesce("path", F.array().cast("array<struct<left:string,right:string>>"))
    proof = F.when(F.col("n") == 1, rest).otherwise(F.concat(F.array(_beside(F.col("hashes"), F.col("i"))), rest))
    return each.select(F.col("m.doc_id").alias("doc_id"), F.col("m.leaf").alias("leaf"), "subroot", F.lit(found["h"] if found else None).cast("string").alias("root"), proof.alias("proof"), *[F.col(f"m.c_{k}").alias(k) for k in carry])


#: The fields of a document, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against tampered ones.

    Where 3 divides the CRC-32 of the doc_id, the text's A-Z are lower-cased and the leaf is hashed anew (a null doc_id is left
    alone); its siblings and it are folded and compared with the root.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = leaf_digest(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(docs, FIELDS, carry={"changed": F.when(hit, other)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
hit AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::UBIGINT)),
         lambda c, b: xor(t[(xor(c, b) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT) % 3 = 0 AS hit
  FROM documents, tab),
fields AS (
  SELECT d.doc_id, coalesce('1' || lang, '0') AS tree,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    CASE WHEN hit THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END AS changed
  FROM documents d JOIN hit ON hit.doc_id = d.doc_id),
leaves AS (SELECT doc_id, tree, sha256(head || body) AS leaf, sha256(head || changed) AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM fields),
g(tree, level, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM g WHERE n > 1 GROUP BY tree, level, idx // 8, n),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM g WHERE n = 1),
u(level, idx, n, h) AS (
  SELECT 0, idx, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
nodes AS (SELECT tree, level, idx, n, h FROM g UNION ALL SELECT '', level, idx, n, h FROM u),
sides AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY 1, 2, 3),
walk(doc_id, tree, level, idx, proof, now) AS (
  SELECT doc_id, tree, 0, idx, '', now FROM leaves
  UNION ALL
  SELECT w.doc_id, s.tree, w.level + 1, w.idx // 8, w.proof || s.l || s.r, sha256(s.l || w.now || s.r) FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx),
mid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS back FROM walk),
over(doc_id, level, idx, proof, now) AS (
  SELECT m.doc_id, 0, s.idx, m.proof, m.now FROM mid m JOIN sub s ON s.tree = m.tree WHERE back = 1
  UNION ALL
  SELECT o.doc_id, o.level + 1, o.idx // 8, o.proof || s.l || s.r, sha256(s.l || o.now || s.r) FROM over o JOIN sides s ON s.tree = '' AND s.level = o.level AND s.idx = o.idx),
done AS (SELECT doc_id, arg_max(proof, level) AS proof, arg_max(now, level) AS now FROM over GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, done.now AS folded_root, done.now = root AS verified
FROM leaves l JOIN sub ON sub.tree = l.tree JOIN done ON done.doc_id = l.doc_id CROSS JOIN (SELECT h AS root FROM u WHERE n = 1) t
"""
