"""Merkle manifest of a table: a hash tree for each language, one over their roots, and every leaf's proof by parent preimages.

A parent's preimage is the string of its children's hashes, 64 characters each. Blocks of ``1 << BITS`` nodes keep the preimages of
all parents inside them, level by level. A leaf's path is the list of its ancestors' preimages: what is left of each
when the path's own slot is cut out are the siblings, and a hash put into the slot instead folds to another root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm._shared import cut, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels inside a block: a block holds 256 nodes, so that no group grows with the table.
BITS = 8
HEX = 64
#: One step of a path: a parent's preimage and where in it the path's own hash stands, from 0.
PATH = "array<struct<preimage:string,slot:int>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, its place from 0 among those of its ``by`` (null is a value) in ``order``, and ``total``, how many these are.

    Rows are ordered once, by ranges, and counted by range; a range's first place is the number of rows in the ranges before. No
    task holds all rows of one ``by``. ``order`` must tell rows apart where their places matter.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    # Written, so that ids given by range stay as they are when a task is run again.
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(by, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total"))
    found = placed.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_in")))
    return found.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_by", "_in", "_shift", "_part", "_id")


def _preimages(hashes: Column) -> Column:
    """The preimages of the parents of an array of hashes: one for each two, the last of one hash if they are odd."""
    places = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    return F.transform(places, lambda i: F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit(""))))


def blocks(nodes: DataFrame, by: str) -> DataFrame:
    """Blocks of nodes (``by``, pos, hash, total, more): ``by, pos, total, low, items, levels, hash``.

    ``pos``, ``total`` and ``hash`` are those of the block as a node of the tier above, ``low`` is its first node's place, ``items`` are its
    nodes (pos, hash, more) in order and ``levels`` the preimages of their parents, level by level: as many levels as a block has,
    fewer only in a tree of one block, which ends at its root.
    """
    grouped = nodes.groupBy(by, F.shiftright("pos", BITS).alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "more"))).alias("items"))
    rows = grouped.withColumn("_h", F.transform("items", lambda x: x["hash"])).withColumn("levels", F.array().cast("array<array<string>>"))
    whole = F.col("total") > (1 << BITS)
    for _ in range(BITS):
        goes_on = whole | (F.size("_h") > 1)
        rows = rows.withColumn("_p", F.when(goes_on, _preimages(F.col("_h"))))
        rows = rows.withColumn("levels", F.when(goes_on, F.concat("levels", F.array("_p"))).otherwise(F.col("levels")))
        rows = rows.withColumn("_h", F.when(goes_on, F.transform("_p", lambda p: F.sha2(p, 256))).otherwise(F.col("_h")))
    return rows.select(
        by, F.col("block").alias("pos"), F.ceil(F.col("total") / F.lit(1 << BITS)).alias("total"), F.shiftleft("block", BITS).alias("low"), "items", "levels",
        F.get("_h", F.lit(0)).alias("hash"),
    )


def _steps(levels: Column, at: Column) -> Column:
    """The path of the node at a place of its block."""

    def step(level: Column, k: Column) -> Column:
        return F.struct(
            F.get(level, F.call_function("shiftright", at, k + 1).cast("int")).alias("preimage"),
            F.call_function("shiftright", at, k).bitwiseAND(F.lit(1)).cast("int").alias("slot"),
        )

    return F.transform(levels, step).cast(PATH)


def paths(nodes: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The lowest blocks of the trees over ``nodes`` with ``up``, their own path, and ``by, root`` of each tree.

    Tiers of blocks are made until each tree is one block, then paths go down again from block to block: nodes only
    ever meet the block they are in.
    """
    tiers = [cut(blocks(nodes, by))]
    while not tiers[-1].where("total > 1").isEmpty():
        above = tiers[-1].select(by, "pos", "hash", "total", F.lit(None).cast("string").alias("more"))
        tiers.append(cut(blocks(above, by)))
    roots = tiers[-1].select(by, F.col("hash").alias("root"))
    down = tiers[-1].withColumn("up", F.array().cast(PATH))
    for tier in reversed(tiers[:-1]):
        own = F.transform(
            "items", lambda x: F.struct(x["pos"].alias("_pos"), F.concat(_steps(F.col("levels"), (x["pos"] - F.col("low")).cast("int")), F.col("up")).alias("up"))
        )
        above = down.select(F.col(by).alias("_by"), F.explode_outer(own).alias("x")).select("_by", "x.*")
        down = tier.join(above, F.col(by).eqNullSafe(F.col("_by")) & (F.col("pos") == F.col("_pos"))).drop("_by", "_pos")
    return down, roots


def siblings(path: Column) -> Column:
    """What the preimages of a path hold besides the path's own hashes, from the leaf up and from left to right."""
    rest = F.transform(path, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), F.substr(s["preimage"], (s["slot"] + 1) * HEX + 1)))
    return F.array_join(rest, "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives: it is put into its slot of each preimage, whose hash goes into the next one's."""

    def step(h: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), h, F.substr(s["preimage"], (s["slot"] + 1) * HEX + 1)), 256)

    return F.aggregate(path, leaf, step)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    other: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the hash of its ``fields``; leaves of one ``group_col`` (null is a group, the first) ascend by id, null ids first,
    rows of one id by leaf; equal rows are leaves of their own with proofs of their own. ``other`` gives the leaf that is folded up the proof
    instead of the row's own (``verified`` tells whether it gives the root), null where it is the own one. A lone row's
    proof is empty. An empty table gives no rows; null, empty and very long texts are hashed like all values; other columns are not read.
    """
    given = docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).alias("lang"), leaf_hash([F.col(c) for c in fields]).alias("hash"),
        (F.lit(None).cast("string") if other is None else other(docs)).alias("more"),
    )
    rows = cut(given.withColumn("row", F.monotonically_increasing_id()))
    leaves = numbered(rows, "lang", ["doc_id", "hash", "row"])
    # The id travels with the leaf inside its block.
    nodes = leaves.select("lang", "pos", "total", "hash", F.struct("doc_id", "more").alias("more"))
    base, subroots = paths(nodes, "lang")
    tops = numbered(cut(subroots.select(F.lit(0).alias("all"), "lang", F.col("root").alias("hash"))), "all", ["lang"])
    top, root = paths(tops.select("all", "pos", "total", "hash", F.col("lang").alias("more")), "all")
    own = F.transform(
        "items", lambda x: F.struct(x["more"].alias("of"), x["hash"].alias("subroot"), F.concat(_steps(F.col("levels"), (x["pos"] - F.col("low")).cast("int")), F.col("up")).alias("top"))
    )
    by_lang = top.select("all", F.explode_outer(own).alias("x")).join(root, "all").select(F.col("x.of").alias("of"), F.col("x.subroot").alias("subroot"), F.col("x.top").alias("top"), "root")
    whole = base.join(cut(by_lang), F.col("lang").eqNullSafe(F.col("of"))).withColumn("up", F.concat("up", "top"))

    def leaf(x: Column) -> Column:
        path = F.concat(_steps(F.col("levels"), (x["pos"] - F.col("low")).cast("int")), F.col("up"))
        return F.struct(
            x["more"]["doc_id"].alias("doc_id"), x["hash"].alias("leaf"), F.sha2(siblings(path), 256).alias("proof_sha256"),
            fold(F.coalesce(x["more"]["more"], x["hash"]), path).alias("folded_root"),
        )

    found = whole.select("subroot", "root", F.explode_outer(F.transform("items", leaf)).alias("x"))
    return found.select(
        "x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified")
    )


def tampered(docs: DataFrame) -> Column:
    """The leaf with n_chars one higher where 7 divides the id's CRC-32; null elsewhere. A null n_chars stays null."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_hash(changed))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), other=tampered)


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB, bit by bit."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(crc, ch), range(8)), lambda c, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, ch: {byte}), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    def shown(c: str) -> str:
        value = f"({n_chars if c == 'n_chars' else c})::VARCHAR"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"

    return f"sha256({' || '.join(map(shown, FIELDS))})"


ORACLE_SQL = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM documents),
low AS (
  SELECT 0 AS level, lang, pos, total, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE total > 1 GROUP BY level, lang, pos // 2, total),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM low WHERE total = 1),
high AS (
  SELECT 0 AS level, pos, total, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE total > 1 GROUP BY level, pos // 2, total),
steps AS (
  SELECT d.doc_id, n.level, xor(d.pos >> n.level, 1) < d.pos >> n.level AS lefts, s.h FROM leaves d
  JOIN low n ON n.lang IS NOT DISTINCT FROM d.lang AND n.pos = d.pos >> n.level AND n.total > 1
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM d.lang AND s.level = n.level AND s.pos = xor(d.pos >> n.level, 1)
  UNION ALL
  SELECT d.doc_id, 100 + n.level, xor(t.pos >> n.level, 1) < t.pos >> n.level, s.h FROM leaves d
  JOIN subroots t ON t.lang IS NOT DISTINCT FROM d.lang JOIN high n ON n.pos = t.pos >> n.level AND n.total > 1
  LEFT JOIN high s ON s.level = n.level AND s.pos = xor(t.pos >> n.level, 1)),
listed AS (SELECT doc_id, list(struct_pack(lefts := lefts, h := coalesce(h, '')) ORDER BY level) AS path FROM steps GROUP BY doc_id),
walk AS (
  SELECT doc_id, coalesce(other, leaf) AS h, coalesce(path, []) AS path, 1 AS k FROM leaves LEFT JOIN listed USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(CASE WHEN path[k].lefts THEN path[k].h || h ELSE h || path[k].h END), path, k + 1 FROM walk WHERE k <= len(path))
SELECT d.doc_id, d.leaf, t.subroot, r.h AS root, sha256(array_to_string(list_transform(w.path, lambda x: x.h), '')) AS proof_sha256,
  w.h AS folded_root, w.h = r.h AS verified
FROM leaves d JOIN subroots t ON t.lang IS NOT DISTINCT FROM d.lang JOIN walk w ON w.doc_id = d.doc_id AND w.k = len(w.path) + 1
CROSS JOIN (SELECT h FROM high WHERE total = 1) r"""
