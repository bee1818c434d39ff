"""Operator 11: Merkle dataset manifest, checkpoint-and-recompute.

Rows are leaves of one tree per language, the trees' roots leaves of a top tree.
Only every few levels are stored, as aligned subtrees: one row holds the up to
2^EVERY stored nodes below one node of the next stored level. The levels between
are never written: a proof regenerates them from the subtree's stored nodes,
emits the siblings on the way up and forgets them. All of it is DataFrame
expressions; no subtree is larger than 2^EVERY nodes whatever a tree's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import id_remainder, let, read, save
from changeflow.llm.ranks import ranked

# Levels from one stored level to the next.
EVERY = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, fields))


def height(n: Column, every: int) -> Column:
    """Levels that a subtree of a level of ``n`` nodes rises: ``every``, or fewer where the tree's root is nearer."""
    return F.least(F.lit(every), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0))


def _count_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def subtree(nodes: Column, levels: Column) -> Column:
    """``nodes`` and the ``levels`` levels above them, lowest first: the interior that is not stored."""

    def parents(below: Column) -> Column:
        pairs = _count_to(F.ceil(F.size(below) / 2).cast("int"))
        return F.transform(pairs, lambda i: digest(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))))

    return F.aggregate(_count_to(levels), F.array(nodes), lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1)))))


def siblings(interior: Column, i: Column, levels: Column) -> Column:
    """(left, h) of the sibling of node ``i``'s ancestor on each of ``levels`` levels; an only child's is the empty text."""

    def one(t: Column) -> Column:
        at = F.call_function("shiftright", i, t)
        other = F.get(F.get(interior, t), at.bitwiseXOR(F.lit(1)))
        return F.struct((at % 2 == 1).alias("left"), F.coalesce(other, F.lit("")).alias("h"))

    return F.transform(_count_to(levels), one)


def fold(start: Column, path: Column) -> Column:
    """The root that ``path`` leads to from the leaf ``start``."""
    return F.aggregate(path, start, lambda h, s: F.when(s["left"], digest(s["h"], h)).otherwise(digest(h, s["h"])))


def _stored(nodes: DataFrame, every: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees of ``nodes`` (tree, n, pos, h, ref), leaves first, and the roots (tree, level, root).

    A row of a stored level is an aligned subtree: tree, n (nodes of the tree on
    this level), block (place on the next stored level), nodes in order, refs.
    """
    width, levels, roots = 2**every, [], []
    while True:
        place = F.floor(F.col("pos") / width).alias("block")
        grouped = nodes.groupBy("tree", "n", place).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "ref"))).alias("s"))
        level = save(grouped.select("tree", "n", "block", F.col("s")["h"].alias("nodes"), F.col("s")["ref"].alias("refs")), f"{name}-{len(levels) * every}")
        heads = level.withColumn("h", F.element_at(F.element_at(subtree(F.col("nodes"), height(F.col("n"), every)), -1), 1))
        roots.append(heads.where(F.col("n") <= width).select("tree", F.lit(len(levels)).alias("level"), F.col("h").alias("root")))
        levels.append(level)
        nodes = heads.where(F.col("n") > width).select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("pos"), "h", F.lit(None).cast("string").alias("ref"))
        if level.where(F.col("n") > width).isEmpty():
            break
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, save(found, f"{name}-roots")


@dataclass
class Manifest:
    """Stored levels of the languages' trees and of the tree above them, with the roots of both."""

    every: int
    levels: list[DataFrame]
    subroots: DataFrame
    top_levels: list[DataFrame]
    root: DataFrame


def manifest(leaves: DataFrame, every: int = EVERY) -> Manifest:
    """The manifest of ``leaves`` (doc_id, lang, leaf, and any payload ``ref``).

    Leaves of a language ascend by doc_id, null first, rows of one doc_id by
    leaf; every row is a leaf, repeated ones too. A null language is a language
    of its own, the first. No rows: no trees and no root.
    """
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "leaf")]
    own = ranked(leaves.withColumnRenamed("lang", "tree"), "tree", order, "merkle-order")
    levels, subroots = _stored(own.select("tree", "n", "pos", F.col("leaf").alias("h"), F.struct("doc_id", "ref").alias("ref")), every, "merkle")
    top = subroots.select(F.lit(0).alias("all"), "tree", F.col("root").alias("h"))
    top = ranked(top, "all", [F.col("tree").asc_nulls_first()], "merkle-top-order")
    top_levels, root = _stored(top.select(F.col("all").alias("tree"), "n", "pos", "h", F.struct("tree").alias("ref")), every, "merkle-top")
    return Manifest(every, levels, subroots, top_levels, root)


def _climb(levels: list[DataFrame], ends: DataFrame, every: int, carried: list[str], name: str) -> DataFrame:
    """(h, ref, path, *carried) of every leaf: the way up from each aligned subtree, the top ones first.

    ``ends`` (tree, level, path, *carried) are the ways up from the roots.
    """
    up = height(F.col("n"), every)

    def nodes(interior: Column) -> Column:
        one = lambda i: F.struct(i.alias("i"), F.get("nodes", i).alias("h"), F.get("refs", i).alias("ref"), siblings(interior, i, up).alias("way"))
        return F.transform(_count_to(F.size("nodes")), one)

    above = None
    for k in reversed(range(len(levels))):
        to = ends.where(F.col("level") == k).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("b"), "path", *carried)
        to = to if above is None else to.unionByName(above)
        level = levels[k]
        at = level.join(to, level["tree"].eqNullSafe(to["t"]) & (level["block"] == to["b"]))
        at = at.select("tree", "block", "path", *carried, F.explode(let(subtree(F.col("nodes"), up), nodes)).alias("node"))
        path = F.concat("node.way", "path").alias("path")
        if k == 0:
            return at.select("node.h", "node.ref", path, *carried)
        above = save(at.select(F.col("tree").alias("t"), (F.col("block") * 2**every + F.col("node.i")).alias("b"), path, *carried), f"{name}-paths")
    raise AssertionError


def proofs(of: Manifest) -> DataFrame:
    """(doc_id, ref, leaf, subroot, root, path) of every leaf; ``path`` holds each level's sibling from the leaf to the root.

    The missing levels of each subtree are regenerated in its row and dropped
    with it; the way up from a subtree's head is shared by all its leaves.
    """
    none = F.array().cast("array<struct<left:boolean,h:string>>")
    top = _climb(of.top_levels, of.root.withColumn("path", none), of.every, ["root"], "merkle-top")
    top = top.select(F.col("ref.tree").alias("sub"), F.col("h").alias("subroot"), "root", "path")
    ends = of.subroots.drop("root").join(top, F.col("tree").eqNullSafe(F.col("sub"))).drop("sub")
    out = _climb(of.levels, save(ends, "merkle-ends"), of.every, ["subroot", "root"], "merkle")
    return out.select("ref.doc_id", "ref.ref", F.col("h").alias("leaf"), "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root and proof digest of every document, and what its leaf, tampered with where 7 divides crc32(doc_id), leads to."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    cols = [F.col(c) for c in FIELDS]
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when((id_remainder(F.col("doc_id"), TAMPERED) == 0) & F.col("n_chars").isNotNull(), leaf(*more))
    leaves = save(docs.select("doc_id", "lang", leaf(*cols).alias("leaf"), tampered.alias("ref")), "merkle-leaves")
    out = proofs(manifest(leaves))
    folded = fold(F.coalesce("ref", "leaf"), F.col("path")).alias("folded_root")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.col("path")["h"], ""), 256).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)
), fields AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS front, coalesce(strlen(text) || ':' || text, '-') AS back,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         sha256(front || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || back) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM fields
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), climbed AS (
  SELECT doc_id, lang, leaf, 0 AS level, pos, n, claimed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM climbed c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), over_langs AS (
  SELECT c.doc_id, c.leaf, s.h AS subroot, 0 AS level, s.pos, s.n, c.h, c.proof FROM climbed c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM over_langs c LEFT JOIN tops s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
)
SELECT o.doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM over_langs o, tops t WHERE o.n = 1 AND t.n = 1
"""
