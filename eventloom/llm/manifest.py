"""A Merkle manifest of a table: leaves, tree levels by slot pivot, proofs and their verification.

Each row is a leaf, the SHA-256 of its columns.  The leaves of one language, by id, form a tree
of fanout 8; the trees' roots, by language, form one more.  A level is made by one grouping:
conditional aggregates spread a parent's children into eight slot columns.  Concatenating the
columns and hashing gives the parent; leaving the own slot column out gives the siblings of a
child.  Proofs are made from the top down, one join a level, by unfolding parents into their
slots, so no node and no group is ever gathered whole.

A leaf's place in its tree is found without one task a tree: rows are range-partitioned by
``(tree, id, leaf)``, numbered within their partition, and moved by the counts of the partitions
before.  Only the depth (a number) and the root (one digest) reach the driver; levels are tables
in the shared folder.

Nulls hash as ``-``; a null language is a tree of its own, the first; a null id stands before all
others; rows of one id stand by their leaf, and equal rows are leaves each (their order changes no
digest).  An empty table gives an empty result; an empty or very long text is hashed whole like
any other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of an id that this divides the crc32 of, the tampered copy is verified.
TAMPERED = 3

_NODE = ("doc_id", "leaf", "tampered")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in order; parts that are null are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    """The text with A-Z lower-cased, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, leaf, tampered)``: the tree's key keeps the order of languages, null first."""
    column = {c: docs[c] for c in FIELDS}
    of = lambda text: digest(*[field(column[c]) for c in FIELDS[:-1]], field(text))
    bad = F.pmod(F.crc32(column["doc_id"].cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    tree = F.when(column["lang"].isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), column["lang"].cast("string")))
    return docs.select(tree.alias("tree"), column["doc_id"].cast("long").alias("doc_id"), of(column["text"]).alias("leaf"), F.when(bad, of(tampered_text(column["text"]))).alias("tampered"))


def placed(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place from 0 within their tree in the order of ``by``, and the tree's ``size``.

    Sorted ranges are numbered apart and stored, then moved by the counts of the ranges before
    them: there are as many counts as ranges and trees.  Rows that are alike in ``by`` are told
    apart by the place they were read from, so that a range can end among them.
    """
    order = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in by], F.col("read")]
    ranged = nodes.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.drop("read").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = numbered.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy("tree").orderBy("part")
    moved = counts.select("tree", "part", "first", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    both = numbered.withColumn("part", F.shiftright("at", 33)).join(moved, ["tree", "part"])
    return both.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "size")


def pivoted(nodes: DataFrame) -> DataFrame:
    """The level above: ``(tree, pos, size, hash, slots)`` of the parents of ``(tree, pos, size, node)``.

    ``slots`` are the eight columns ``c0`` to ``c7``, each a child's ``node`` struct or null.
    """
    slot = F.pmod("pos", F.lit(FANOUT))
    columns = [F.max(F.when(slot == j, F.col("node"))).alias(f"c{j}") for j in range(FANOUT)]
    above = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.max("size").alias("below"), *columns)
    size = F.expr(f"(below + {FANOUT - 1}) div {FANOUT}")
    return above.withColumns({"size": size, "hash": digest(*[F.col(f"c{j}.leaf") for j in range(FANOUT)])}).drop("below")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``(tree, pos, size, node)``, lowest first; a tree ends at its level of one node."""
    depth, most = 0, nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        depth, most = depth + 1, -(-most // FANOUT)
    out, here = [], nodes
    for _ in range(depth):
        above = materialize(pivoted(here.where("size > 1")))
        out.append(above)
        here = above.select("tree", "pos", "size", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("tampered")).alias("node"))
    return out


def children(level: DataFrame, paths: DataFrame) -> DataFrame:
    """The children of a level's nodes with their own paths, given the nodes' paths: an unfolding of the slots.

    A path lists, from the node's own level upwards, what stands left and right of it in its run.
    """
    name = [f"c{j}" for j in range(FANOUT)]
    digests = lambda some: F.concat_ws("", *[F.col(f"{c}.leaf") for c in some])
    slots = F.array(
        *[F.struct((F.col("pos") * FANOUT + j).alias("pos"), F.col(c).alias("node"), F.struct(digests(name[:j]).alias("left"), digests(name[j + 1 :]).alias("right")).alias("run")) for j, c in enumerate(name)]
    )
    both = level.join(paths, ["tree", "pos"])
    child = both.select("tree", "subroot", "path", F.explode(F.filter(slots, lambda s: s["node"].isNotNull())).alias("s"))
    return child.select("tree", F.col("s.pos").alias("pos"), F.col("s.node").alias("node"), "subroot", F.concat(F.array("s.run"), F.col("path")).alias("path"))


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """``(tree, subroot)``: what remains of each tree; of a lone leaf, itself."""
    out = nodes.where("size = 1").select("tree", F.col("node.leaf").alias("subroot"))
    for level in above:
        out = out.unionByName(level.where("size = 1").select("tree", F.col("hash").alias("subroot")))
    return out


def proofs(nodes: DataFrame, above: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(tree, pos, node, subroot, path)`` of every node at the bottom, given ``(tree, subroot, path)`` of the roots."""
    start = tops.withColumn("pos", F.lit(0).cast("long"))
    down = None
    for level in reversed(above):
        ends = level.where("size = 1").select("tree", "pos").join(start, ["tree", "pos"])
        known = ends.select("tree", "pos", "subroot", "path")
        known = known if down is None else known.unionByName(down.select("tree", "pos", "subroot", "path"))
        down = children(level, known)
    alone = nodes.where("size = 1").select("tree", "pos", "node").join(tops, "tree").select("tree", "pos", "node", "subroot", "path")
    return alone if down is None else alone.unionByName(down.select("tree", "pos", "node", "subroot", "path"))


_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its leaf, its tree's root, the whole root, its proof and the proof's verification."""
    bottom = placed(leaves(docs), ["doc_id", "leaf"]).select("tree", "pos", "size", F.struct(*_NODE).alias("node"))
    above = levels(bottom)
    one = roots(bottom, above).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "subroot")
    listed = placed(one, ["lang"])
    top = listed.select("tree", "pos", "size", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("subroot").alias("leaf"), F.col("lang").alias("tampered")).alias("node"))
    over = levels(top)
    found = roots(top, over).first()
    root = F.lit(found["subroot"] if found else None).cast("string")
    start = top.sparkSession.range(1).select(F.lit("").alias("tree"), root.alias("subroot"), F.array().cast(_PATH).alias("path"))
    tops = proofs(top, over, start).select(F.col("node.tampered").alias("tree"), F.col("node.leaf").alias("subroot"), "path")
    proof = proofs(bottom, above, tops)
    folded = F.aggregate("path", F.coalesce("node.tampered", "node.leaf"), lambda acc, run: digest(run["left"], acc, run["right"]))
    siblings = F.concat_ws("", F.transform("path", lambda run: F.concat(run["left"], run["right"])))
    out = proof.select(F.col("node.doc_id").alias("doc_id"), F.col("node.leaf").alias("leaf"), "subroot", root.alias("root"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The manifest in DuckDB: levels and foldings by recursion, crc32 bit by bit."""
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    of = lambda text: f"sha256({' || '.join(one(c) for c in FIELDS[:-1])} || {one(text)})"
    step = "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    octets = "flatten([[ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN range(1, length(doc_id::VARCHAR) + 1)])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, e: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grown = lambda name, start: (
        f"{name} AS ({start} UNION ALL SELECT l + 1, tree, pos // {FANOUT}, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE n > 1 GROUP BY l, tree, pos // {FANOUT})"
    )
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {of('text')} AS leaf, CASE WHEN {crc} % {TAMPERED} = 0 THEN {of(lower)} END AS bad FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    {grown('nodes', "SELECT 0 AS l, tree, pos, leaf AS d, n FROM placed")},
    subroots AS (SELECT tree, d, l AS depth FROM nodes WHERE n = 1),
    {grown('tops', "SELECT 0 AS l, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, d, count(*) OVER () AS n FROM subroots")},
    places AS (SELECT tree, depth, row_number() OVER (ORDER BY encode(tree)) - 1 AS top FROM subroots),
    every AS (SELECT l, tree, pos, d FROM nodes UNION ALL SELECT l + 1000, tree, pos, d FROM tops),
    runs AS (SELECT l, tree, pos, coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY l, tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY l, tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM every),
    height AS (SELECT max(l) AS top FROM tops),
    steps AS (SELECT p.tree, p.pos, k, CASE WHEN k < q.depth THEN k ELSE k - q.depth + 1000 END AS l, CASE WHEN k < q.depth THEN p.tree ELSE '' END AS at_tree, CASE WHEN k < q.depth THEN p.pos // ({FANOUT}::BIGINT ** k)::BIGINT ELSE q.top // ({FANOUT}::BIGINT ** (k - q.depth))::BIGINT END AS at_pos
      FROM placed p JOIN places q USING (tree), height, range(60) r(k) WHERE k < q.depth + height.top),
    path AS (SELECT s.tree, s.pos, list(struct_pack(b := r.before, a := r.after) ORDER BY k) AS path FROM steps s JOIN runs r ON r.l = s.l AND r.tree = s.at_tree AND r.pos = s.at_pos GROUP BY s.tree, s.pos),
    whole AS (SELECT d AS root FROM tops WHERE n = 1),
    folding AS (SELECT p.tree, p.pos, 1 AS k, coalesce(p.bad, p.leaf) AS d, coalesce(a.path, []) AS path FROM placed p LEFT JOIN path a USING (tree, pos)
      UNION ALL SELECT tree, pos, k + 1, sha256(path[k].b || d || path[k].a), path FROM folding WHERE k <= len(path))
    SELECT p.doc_id, p.leaf, q.d AS subroot, root, sha256(array_to_string([x.b || x.a FOR x IN f.path], '')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
    FROM placed p JOIN subroots q USING (tree) JOIN folding f ON f.tree = p.tree AND f.pos = p.pos AND f.k = len(f.path) + 1, whole"""


ORACLE_SQL = _sql()
