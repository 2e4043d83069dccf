"""Merkle fingerprints of documents: runs of words, paragraphs, sections, root; likeness and places of edits from them alone."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.tables import pin

#: A section: at most 16 lines, ended early by an empty one. A leaf: at most 8 words with the spaces after them.
SECTION = r"(?:[^\n]+\n){0,15}[^\n]*\n?"
LEAF = r"(?:[^ ]* ){1,8}|[^ ]+"
#: Rows in a cell of neighbouring documents, and the finest cell: so many ids (as a power of two) in a row.
CELL_ROWS, FINEST = 4096, 10
WIDTHS = range(FINEST, 64, 2)


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _digest(kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), value).cast("binary"), 256)


def merkle(text: Column) -> Column:
    """The tree of a text as a struct (digest, body); null counts as empty.

    Lines are paragraphs; sections are blocks of at most 16 lines that end at an empty line; leaves are runs of at most 8 words of a
    paragraph. Every code point is in a leaf or ends a paragraph. A node's digest is the SHA-256 of its kind and its children's
    digests, so equal roots mean equal texts. `body` keeps 24 bits per leaf (4 characters), "." between paragraphs and ";" between
    sections.
    """
    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda x: _digest("l", x))
        return _let(leaves, lambda x: F.struct(_digest("p", F.array_join(x, "")).alias("digest"), F.array_join(
            F.transform(x, lambda h: F.base64(F.unhex(F.substring(h, 1, 6)))), "").alias("body")))

    def joined(kind: str, between: str):
        return lambda x: F.struct(_digest(kind, F.array_join(x["digest"], "")).alias("digest"), F.array_join(x["body"], between).alias("body"))

    def section(block: Column) -> Column:
        return _let(F.transform(F.split(block, "\n"), paragraph), joined("s", "."))

    blocks = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION), F.lit(0)), lambda x: x != "")
    return _let(F.transform(blocks, section), joined("r", ";"))


def fingerprint(text: Column) -> Column:
    """Root (64 hex digits), ":" and the short leaves by section and paragraph (see `merkle`)."""
    return _let(merkle(text), lambda tree: F.concat_ws(":", tree["digest"], F.translate(tree["body"], "+/", "-_")))


def _root(mark: Column) -> Column:
    return F.substring(mark, 1, 64)


def _body(mark: Column) -> Column:
    return F.substr(mark, F.lit(66))


def _leaves(mark: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_body(mark), F.lit("[A-Za-z0-9_-]{4}"), F.lit(0)))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: 1 where roots are equal, else twice the different leaves in common over the different leaves of both."""
    def dice(x: Column) -> Column:
        both = F.size(x["a"]) + F.size(x["b"])
        return F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x["a"], x["b"])).cast("double") / both.cast("double"))

    return F.when(_root(one) == _root(other), F.lit(1.0)).otherwise(_let(F.struct(_leaves(one).alias("a"), _leaves(other).alias("b")), dice))


def changed_paragraphs(one: Column, other: Column) -> Column:
    """Sections and paragraphs (both from 0) of `one` whose branch `other` does not have, in order; empty where roots are equal."""
    def places(apart: Column) -> Column:
        def of(block: Column, at: Column) -> Column:
            found = F.transform(F.split(block, "[.]"), lambda p, i: F.when(F.array_contains(apart, p), F.struct(at.alias("section"), i.alias("paragraph"))))
            return F.filter(found, lambda x: x.isNotNull())

        return F.flatten(F.transform(F.split(_body(one), ";"), of))

    return _let(_apart(one, other), places)


def _apart(one: Column, other: Column) -> Column:
    """The different paragraph branches of `one` that `other` does not have."""
    found = F.array_except(F.split(_body(one), "[.;]"), F.split(_body(other), "[.;]"))
    return F.when(_root(one) == _root(other), F.filter(found, lambda x: F.lit(False))).otherwise(found)


def _cells(ids: DataFrame) -> tuple[int, DataFrame]:
    """The widest cells (of 2^width ids) that hold at most CELL_ROWS rows, and the cells that hold more.

    Ids that pile up in a finest cell do not count for the width.
    """
    fine = pin(ids.groupBy(F.shiftright("id", FINEST).alias("cell")).agg(F.count(F.lit(1)).alias("rows")))
    wide = fine.where(F.col("cell").isNotNull() & (F.col("rows") <= CELL_ROWS)).select(
        F.explode(F.array(*[F.lit(w) for w in WIDTHS])).alias("width"), "cell", "rows")
    sizes = wide.groupBy("width", F.expr(f"shiftright(cell, width - {FINEST})").alias("cell")).agg(F.sum("rows").alias("rows"))
    fits = sizes.groupBy("width").agg(F.max("rows").alias("most")).where(F.col("most") <= CELL_ROWS)
    width = fits.agg(F.max("width")).first()[0] or FINEST
    heavy = fine.groupBy(F.shiftright("cell", width - FINEST).alias("p_cell")).agg(F.sum("rows").alias("rows")).where(F.col("rows") > CELL_ROWS)
    return width, pin(heavy.select("p_cell"))


def _next_cells(cells: DataFrame) -> DataFrame:
    """Each cell's place `at` in the order (see `_place`) with the `next` one; the first follows the last.

    Neighbours are found within blocks of cells, and across blocks from a table of blocks, a millionth of the rows.
    """
    rows = cells.select("at", F.when(~F.col("at.none"), F.shiftright("at.cell", 10)).alias("block"))
    inner = rows.withColumn("next", F.lead("at").over(Window.partitionBy("block").orderBy("at")))
    blocks = rows.groupBy("block").agg(F.min("at").alias("first"))
    after = F.coalesce(F.lead("first").over(Window.orderBy("first")), F.min("first").over(Window.partitionBy()))
    blocks = blocks.select(F.col("block").alias("b"), after.alias("after"))
    return inner.join(blocks, F.col("block").eqNullSafe(F.col("b"))).select(F.col("at").alias("of"), F.coalesce("next", "after").alias("next"))


def _place() -> Column:
    """Where a cell stands: descending by cell and, inside cut cells, by id, nulls last, then by part of the hashes."""
    zero = F.lit(0).cast("long")
    return F.struct(F.col("cell").isNull().alias("none"), F.coalesce(F.bitwise_not("cell"), zero).alias("cell"),
                    F.col("sub").isNull().alias("no_sub"), F.coalesce(F.bitwise_not("sub"), zero).alias("sub"), F.col("part").alias("part"))


def _compare(near: DataFrame) -> DataFrame:
    """From text, print, next_text and next_print: the edited text's digest and fingerprint, and the likeness of both."""
    edited = near.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.expr(
        "concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_print", fingerprint(F.col("edited")))
    one, other = F.col("print"), F.col("edited_print")
    return edited.withColumn("near_edited", likeness(one, other)).withColumn("near_next", likeness(one, F.col("next_print"))).withColumn(
        "changed", F.size(_apart(one, other)))


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last half comes from the next document, and of that document.

    `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed` (the different paragraph
    branches that the edit does away with). Next is the following document by descending id (nulls last, then equal ids by a hash of
    the text and the text); the first follows the last, and a document that is alone follows itself. So of rows that repeat id and
    text, each but the last is followed by its copy. Null texts count as empty; ids are integers; other columns are not read; an empty
    table gives no rows.

    Texts are dealt once, by cells of neighbouring ids whose width follows from counts of the ids. Cells in which ids pile up
    (repeated or null) are cut further by id and a hash of the text, copies being counted first. A cell's last text meets the next
    cell's first one in a join by cell.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width, heavy = _cells(rows.select("id"))
    rows = rows.withColumn("cell", F.shiftright("id", width))
    same = F.col("cell").eqNullSafe(F.col("p_cell"))
    plain = rows.join(heavy, same, "left_anti").select("id", "text", "cell", F.lit(None).cast("long").alias("sub"), F.lit(0).alias("part"),
                                                      F.lit(1).cast("long").alias("copies"))
    cut = rows.join(heavy, same, "left_semi").groupBy("id", "text", "cell").agg(F.count(F.lit(1)).alias("copies")).select(
        "id", "text", "cell", F.col("id").alias("sub"), F.shiftright(F.xxhash64("text"), 52).cast("int").alias("part"), "copies")
    dealt = plain.unionByName(cut).repartition("cell", "sub", "part").withColumn("print", fingerprint(F.col("text")))
    cell = Window.partitionBy("cell", "sub", "part").orderBy(F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    near = dealt.withColumn("next_text", F.lead("text").over(cell)).withColumn("next_print", F.lead("print").over(cell)).withColumn(
        "first", F.row_number().over(cell) == 1).withColumn("last", F.col("next_text").isNull())
    told = ["id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next", "changed"]
    found = pin(_compare(near).select(*told, "copies", "first", "last", _place().alias("at"),
                                      F.when(F.col("first") | F.col("last") | (F.col("copies") > 1), F.col("text")).alias("text")))
    heads = found.where("first").select("at", F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    heads = heads.join(_next_cells(heads.select("at")), F.col("at") == F.col("next")).select("of", "next_text", "next_print")
    edge = _compare(found.where("last").select("id", "at", "text", "print").join(heads, F.col("at") == F.col("of")))
    again = _compare(found.where(F.col("copies") > 1).select("id", "text", "print", F.col("text").alias("next_text"), F.col("print").alias("next_print"),
                                                             F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("copy")))
    done = found.where(~F.col("last")).select(*told).unionByName(edge.select(*told)).unionByName(again.select(*told))
    return done.withColumnsRenamed({"id": "doc_id", "print": "fingerprint", "edited_print": "edited_fingerprint"})
