"""Three-way merge of two branches of a table of texts, in a uniform cell model.

Each version (base, left, right) is a set of cells, path -> value. A path is (id, part, kind, pos): the row itself, a column, a line of the base text, the gap after such a line
(whose value is what was inserted there), or a whole row that the base lacks. A version lacks the cells of what it dropped. The versions' cells are united, grouped by path and
pivoted to three values; a path that one side changed, or both in the same way, is clean, any other change of both is a conflict and takes the base's state. Rows are put together again
from their resolved cells.

A row drop counts alone. If the other branch keeps the row with changes, that is one edit-delete conflict and the base's row stays whole; else it is one clean drop.

`cells` makes the three versions of a table in one pass, from a rule that edits by a code of each element; `merge` takes cells of any origin. Cells that are partitioned by id already, as those of `cells`
are, are grouped where they lie: the texts move once. Groups are rows of the base, so that a task holds one text at a time.

Cases: nulls count as empty values. Equal rows of one id are one row; unlike rows of one id (or of none, whose codes have an empty id) are told apart by `part` and merged each by itself. A
null id adds no rows; if unlike rows of one id add a row, the greater value counts. An added row whose id a base row has is a result row of its own. An empty text is
one empty line; very long texts are merged whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of paths, in the order in which a row's cells are counted.
ROW, COLUMN, LINE, GAP, WHOLE = range(5)
COLUMNS = ("lang", "source")
MODULUS = 11
CELL = "struct<version:string,kind:int,pos:int,value:string>"
_ADDED = "lang string, source string, text string"


def code(branch: str, key: Column, name: Column) -> Column:
    """What a branch does to an element: crc32("branch:id:name") modulo 11."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{branch}:"), key, F.lit(":"), name).cast("binary")), F.lit(MODULUS)).cast("int")


def _marked(c: Column, value: Column) -> Column:
    return F.when(c == 1, F.concat(value, F.lit("!"))).when(c == 2, F.concat(value, F.lit("?"))).otherwise(value)


def _rows(docs: DataFrame, key: str) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*COLUMNS, "text")]
    named = docs.select(F.col(key).alias("id"), *text).withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return named.withColumn("part", F.xxhash64(*COLUMNS, "text"))


def cells(docs: DataFrame, key: str = "doc_id", branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """(id, part, version, kind, pos, value) of the base and of both branches of it, for the rows of the base; version is B or a branch's name."""
    rows = _rows(docs, key).repartition("id", "part")
    for b in branches:
        rows = rows.withColumn(f"row_{b}", code(b, F.col("name"), F.lit("row")))
    # the row, its columns, its lines: one element each
    parts = F.concat(F.array(F.lit(""), *COLUMNS), F.split("text", "\n", -1))
    each = rows.select("id", "part", "name", *[f"row_{b}" for b in branches], F.posexplode(parts).alias("at", "base"))
    lines = 1 + len(COLUMNS)
    kind = F.when(F.col("at") == 0, F.lit(ROW)).when(F.col("at") < lines, F.lit(COLUMN)).otherwise(F.lit(LINE))
    label = F.when(F.col("at") == 0, F.lit("row"))
    for i, c in enumerate(COLUMNS):
        label = label.when(F.col("at") == 1 + i, F.lit(c))
    label = label.otherwise((F.col("at") - lines).cast("string"))
    pos = F.when(F.col("at") == 0, F.lit(0)).when(F.col("at") < lines, F.col("at") - 1).otherwise(F.col("at") - lines)
    each = each.select("*", kind.alias("kind"), pos.alias("pos"), *[code(b, F.col("name"), label).alias(f"code_{b}") for b in branches])

    def cell(version: str, kind: Column, value: Column) -> Column:
        return F.struct(F.lit(version).alias("version"), kind.alias("kind"), F.col("pos").alias("pos"), value.alias("value")).cast(CELL)

    made = [cell("B", F.col("kind"), F.col("base"))]
    for b in branches:
        c, is_line, held = F.col(f"code_{b}"), F.col("kind") == LINE, F.col(f"row_{b}") != 0
        value = F.when(F.col("kind") == ROW, F.col("base")).when((F.col("kind") == COLUMN) & (c == 0), F.lit("")).otherwise(_marked(c, F.col("base")))
        made.append(F.when(held & ~(is_line & (c == 0)), cell(b, F.col("kind"), value)))
        made.append(F.when(held & is_line & c.isin(3, 4), cell(b, F.lit(GAP), F.when(c == 3, F.lit("!")).otherwise(F.lit("?")))))
    # inline leaves out no null struct, so the absent cells go by their version
    return each.select("id", "part", F.explode(F.array(*made)).alias("c")).where(F.col("c").isNotNull()).select("id", "part", "c.version", "c.kind", "c.pos", "c.value")


def added(docs: DataFrame, key: str = "doc_id", branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """The cells of whole rows that the branches add: the first branch under -1 - id, the second under -2 - id."""
    rows = _rows(docs, key).where(F.col("id").isNotNull())
    made = []
    for i, b in enumerate(branches):
        c = code(b, F.col("name"), F.lit("row"))
        text = F.when(c == 3, F.lit("!")).when(c == 4, F.lit("?"))
        fresh = (F.lit(-1 - i) - F.col("id")).cast(docs.schema[key].dataType)
        made.append(F.struct(fresh.alias("id"), F.lit(b).alias("version"), text.alias("text")))
    each = rows.select(*COLUMNS, F.explode(F.array(*made)).alias("m")).where(F.col("m.text").isNotNull())
    value = F.to_json(F.struct(*COLUMNS, F.col("m.text").alias("text")))
    return each.select("m.id", F.lit(0).cast("long").alias("part"), "m.version", F.lit(WHOLE).alias("kind"), F.lit(0).alias("pos"), value.alias("value"))


def pivoted(cells: DataFrame, branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """A row for each path: its value in the base and in both branches, null where it is absent."""
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    return cells.groupBy("id", "part", "kind", "pos").agg(of("B").alias("base"), of(branches[0]).alias("left"), of(branches[1]).alias("right"))


def merge(cells: DataFrame, key: str = "doc_id", branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """(key, lang, source, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) of every id that is in any version; a row that is absent in the
    end has nulls for its columns and text."""
    by_left, by_right = ~F.col("left").eqNullSafe(F.col("base")), ~F.col("right").eqNullSafe(F.col("base"))
    paths = pivoted(cells, branches).select("*", by_left.alias("by_left"), by_right.alias("by_right"), (~F.col("left").eqNullSafe(F.col("right"))).alias("apart"))
    conflict = F.col("by_left") & F.col("by_right") & F.col("apart")
    resolved = F.when(conflict, F.col("base")).when(F.col("by_left"), F.col("left")).otherwise(F.col("right"))
    paths = paths.select("*", conflict.alias("conflict"), resolved.alias("merged"))

    is_row, is_whole = F.col("kind") == ROW, F.col("kind") == WHOLE
    clash, inner = F.col("conflict"), ~F.col("kind").isin(ROW, WHOLE)
    dropped = F.col("kind").isin(LINE) & (F.col("left").isNull() | F.col("right").isNull())
    count = lambda c: F.count_if(inner & c)
    line = F.struct("pos", "kind", "base", F.when(F.col("merged").eqNullSafe(F.col("base")), F.lit(None)).otherwise(F.col("merged")).alias("merged"), F.col("merged").eqNullSafe(F.col("base")).alias("same"))
    column = {c: (F.col("kind") == COLUMN) & (F.col("pos") == i) for i, c in enumerate(COLUMNS)}
    rows = paths.groupBy("id", "part").agg(
        F.max(is_whole).alias("whole"), F.max(F.when(is_whole, F.col("merged"))).alias("fresh"), F.max(is_whole & clash).alias("fresh_clash"),
        F.max(is_row & F.col("left").isNull()).alias("left_drops"), F.max(is_row & F.col("right").isNull()).alias("right_drops"),
        F.max(inner & F.col("by_left")).alias("left_edits"), F.max(inner & F.col("by_right")).alias("right_edits"),
        count((F.col("by_left") | F.col("by_right")) & ~clash).alias("clean"), count(clash & (F.col("kind") != GAP) & ~dropped).alias("edit_edit"),
        count(clash & dropped).alias("edit_delete"), count(clash & (F.col("kind") == GAP)).alias("insert_insert"),
        *[F.max(F.when(is_c, F.col(v))).alias(f"{c}_{v}") for c, is_c in column.items() for v in ("base", "merged")],
        F.collect_list(F.when(F.col("kind").isin(LINE, GAP), line)).alias("lines"),
    )

    alone = F.col("left_drops") | F.col("right_drops")
    kept_edits = (F.col("left_drops") & ~F.col("right_drops") & F.col("right_edits")) | (F.col("right_drops") & ~F.col("left_drops") & F.col("left_edits"))
    state = F.when(F.col("whole"), F.when(F.col("fresh_clash"), F.lit("absent")).otherwise(F.lit("fresh"))).when(alone & kept_edits, F.lit("base")).when(alone, F.lit("absent")).otherwise(F.lit("merged"))
    rows = rows.withColumn("state", state).withColumn("given", F.from_json("fresh", _ADDED)).withColumn("lines", F.array_sort("lines"))

    def text(of) -> Column:
        return F.array_join(F.filter(F.transform("lines", of), lambda v: v.isNotNull()), "\n")

    def shown(fresh: Column, base: Column, merged: Column) -> Column:
        return F.when(F.col("state") == "fresh", fresh).when(F.col("state") == "base", base).when(F.col("state") == "merged", merged)

    def number(fresh: Column, drop: Column, merged: Column) -> Column:
        return F.when(F.col("whole"), fresh).when(alone, drop).otherwise(merged).cast("long")

    zero = F.lit(0)
    return rows.select(
        F.col("id").alias(key), *[shown(F.col(f"given.{c}"), F.col(f"{c}_base"), F.col(f"{c}_merged")).alias(c) for c in COLUMNS],
        shown(F.col("given.text"), text(lambda x: x["base"]), text(lambda x: F.when(x["same"], x["base"]).otherwise(x["merged"]))).alias("text"),
        number((~F.col("fresh_clash")).cast("int"), (~kept_edits).cast("int"), F.col("clean")).alias("n_clean"),
        number(zero, zero, F.col("edit_edit")).alias("n_edit_edit"), number(zero, kept_edits.cast("int"), F.col("edit_delete")).alias("n_edit_delete"),
        number(F.col("fresh_clash").cast("int"), zero, F.col("insert_insert")).alias("n_insert_insert"),
    )


def merged_rows(docs: DataFrame, key: str = "doc_id", branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """The merge of the two branches that `code` makes of docs, with every row that either of them adds."""
    return merge(cells(docs, key, branches), key, branches).unionByName(merge(added(docs, key, branches), key, branches))
