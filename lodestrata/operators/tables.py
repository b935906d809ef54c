"""Table operators on a column of rows (array of arrays of nullable cells): no shuffle, one row per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bound, let
from ..functions.text import clean_text, trim_all
from ..profile import DEFAULT, FILL_RATE, REGISTER_COLUMNS, TABLE_CHARS, TABLE_COLUMNS, Profile

EMPTY = "array<string>"


def cell(c: Column) -> Column:
    """A cell's text with single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))  # there are only blanks left to trim


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def column_count(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _read(clean: bool):
    """How cells are read: those that were cleaned before only lack their nulls."""
    return (lambda c: F.coalesce(c, F.lit(""))) if clean else cell


def filled(row: Column, clean: bool = False) -> Column:
    return F.size(F.filter(row, lambda c: _read(clean)(c) != ""))


def drop_noise(rows: Column, profile: Profile = DEFAULT, noise: str = "i") -> Column:
    """Cells cleaned as page text is; those that hold only a border's letter become null, and rows without any text go.

    Decide by is_plausible() first: it looks at the rows as they were found.
    """
    cleaned = F.transform(rows, lambda r: F.transform(r, lambda c: F.when(trim_all(c) != noise, clean_text(trim_all(c), profile))))
    return F.filter(cleaned, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))


def is_plausible(rows: Column) -> Column:
    """False for tables that heading lines were mistaken for: many columns, and a lone cell in the first or last row, or few cells filled."""
    cells = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(r))
    full = F.aggregate(rows, F.lit(0), lambda n, r: n + filled(r))
    lone = (filled(F.element_at(rows, 1)) == 1) | (filled(F.element_at(rows, -1)) == 1)
    wide = ~lone & (F.when(cells > 0, full / cells).otherwise(0.0) >= FILL_RATE)
    return F.when(F.size(rows) <= 0, False).when(column_count(rows) <= TABLE_COLUMNS, True).otherwise(wide)


def first_data_row(rows: Column, columns: Column, clean: bool = False) -> Column:
    """Number from 0 of the first row with a key and at least half of its cells; 1 if there is none."""
    least = F.greatest(F.lit(1), F.floor((columns + 1) / 2).cast("int"))
    full = F.filter(_range(F.size(rows)), lambda i: (_read(clean)(F.get(F.get(rows, i), F.lit(0))) != "") & (filled(F.get(rows, i), clean) >= least))
    return F.coalesce(F.get(full, F.lit(0)), F.lit(1))


def merge_header(rows: Column, columns: Column, clean: bool = False) -> Column:
    """One header row: the texts of each column's cells, joined by blanks."""
    return F.transform(_range(columns), lambda j: F.array_join(F.filter(F.transform(rows, lambda r: _read(clean)(F.get(r, j))), lambda c: c != ""), " "))


def _is_note(row: Column) -> Column:
    first = F.get(row, F.lit(0))
    return first.rlike(r"^(?i:NOTE)\b") & ~F.exists(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), lambda c: c != "")


def note_count(body: Column) -> Column:
    """Length of the run of note rows at the end."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    run = F.aggregate(F.reverse(body), zero, lambda s, r: F.struct((s["n"] + (s["open"] & F.coalesce(_is_note(r), F.lit(False))).cast("int")).alias("n"), (s["open"] & F.coalesce(_is_note(r), F.lit(False))).alias("open")))
    return run["n"]


def notes_text(rows: Column) -> Column:
    """The first cells of note rows by line; numbered notes that one cell holds get lines of their own."""
    return F.array_join(F.transform(rows, lambda r: F.regexp_replace(F.get(r, F.lit(0)), r"(?i) (NOTE \d)", "\n$1")), "\n")


def _cut(items: Column, starts: Column) -> Column:
    """items in slices that begin at these places (from 0, rising); what is before the first is left out."""
    return let(F.struct(items.alias("x"), starts.alias("at")), lambda v: F.transform(v["at"], lambda a, k: F.slice(v["x"], a + 1, F.coalesce(F.get(v["at"], k + 1), F.size(v["x"])) - a)))


def forward_fill(body: Column) -> Column:
    """Every row's empty key takes the last key above it; empty keys at the top stay. Cuts the rows at their keys: linear in them."""

    def fill(rows: Column) -> Column:
        keyed = F.filter(_range(F.size(rows)), lambda i: F.get(F.get(rows, i), F.lit(0)) != "")

        def filled_run(run: Column) -> Column:
            key = F.get(F.get(run, F.lit(0)), F.lit(0))
            return F.transform(run, lambda r: F.when(F.size(r) > 0, F.concat(F.array(key), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))).otherwise(r))

        return let(keyed, lambda at: F.concat(F.slice(rows, F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.size(rows))), F.flatten(F.transform(_cut(rows, at), filled_run))))

    return let(body, fill)


def preprocess(tables: DataFrame, rows: str = "rows", header_mode: str = "reference") -> DataFrame:
    """tables with columns, header, body and notes.

    header_mode "reference": a first row that is complete is data, and the header is empty; "fixed": it is the header.
    A table that is null or has no rows has an empty header and body.
    """
    given = F.transform(F.coalesce(F.col(rows), F.array().cast(f"array<{EMPTY}>")), lambda r: F.transform(r, cell))  # each cell once
    start = lambda v: first_data_row(v["given"], v["columns"], True)
    if header_mode == "fixed":
        start = lambda v: F.greatest(first_data_row(v["given"], v["columns"], True), F.lit(1))
    elif header_mode != "reference":
        raise ValueError(header_mode)
    t = bound(tables, __v=F.struct(given.alias("given"), column_count(given).alias("columns")))
    v = F.col("__v")
    n = F.size(v["given"])
    t = bound(t, columns=v["columns"], data_start=F.when(n > 0, F.least(start(v), n)).otherwise(0))
    header = F.when(n > 0, merge_header(F.slice(v["given"], F.lit(1), F.col("data_start")), F.col("columns"), True)).otherwise(F.array().cast(EMPTY))
    data = F.slice(v["given"], F.col("data_start") + 1, F.greatest(n - F.col("data_start"), F.lit(0)))
    t = bound(t, header=header, __body=F.transform(data, lambda r: F.transform(_range(F.col("columns")), lambda j: F.coalesce(F.get(r, j), F.lit("")))))
    t = bound(t, n_notes=note_count(F.col("__body")))
    rest = F.size("__body") - F.col("n_notes")
    t = bound(t, notes=notes_text(F.slice("__body", rest + 1, F.col("n_notes"))), body=forward_fill(F.slice("__body", F.lit(1), rest)))
    return t.drop("__v", "__body")


def row_text(r: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))


def rule(header: Column) -> Column:
    return F.transform(header, lambda h: F.repeat(F.lit("-"), F.greatest(F.length(h), F.lit(3))))


def markdown(header: Column, body: Column, notes: Column) -> Column:
    """The Markdown table, with its notes below; an empty text without a header row."""
    lines = F.concat(F.array(row_text(header), row_text(rule(header))), F.transform(body, row_text))
    tail = F.when(notes != "", F.concat(F.lit("\n\n**Notes:**\n"), notes)).otherwise("")
    return F.when(F.size(header) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), tail))


def _block(header: Column, rows: Column) -> Column:
    return F.array_join(F.concat(F.array(row_text(header), row_text(rule(header))), F.transform(rows, row_text)), "\n")


def row_groups(header: Column, body: Column, notes: Column, register: Column) -> Column:
    """(index, key, markdown) of each key's rows, in order of first appearance; notes go to the last.

    Tables of register bits (by the first column's name) name their register above each group. The rows' places are
    sorted by key once and cut where the key changes.
    """
    first = F.lower(F.get(header, F.lit(0)))
    is_register = first.rlike("|".join(REGISTER_COLUMNS))
    context = F.when(is_register, F.concat(F.lit("**Register Context: "), F.coalesce(register, F.lit("Register")), F.lit("**\n\n"))).otherwise("")
    some = (F.size(header) > 0) & (F.size(body) > 0)

    def grouped(v: Column) -> Column:
        placed = F.array_sort(F.transform(v["body"], lambda r, i: F.struct(F.get(r, F.lit(0)).alias("key"), i.alias("i"))))

        def runs(p: Column) -> Column:
            heads = F.filter(_range(F.size(p)), lambda j: (j == 0) | ~F.get(p, j)["key"].eqNullSafe(F.get(p, F.greatest(j - 1, F.lit(0)))["key"]))
            return F.array_sort(F.transform(_cut(p, heads), lambda g: F.struct(F.get(g, F.lit(0))["i"].alias("first"), g.alias("rows"))))

        def told(groups: Column) -> Column:
            def one(g, i):
                own = F.transform(g["rows"], lambda x: F.get(v["body"], x["i"]))
                tail = F.when((i == F.size(groups) - 1) & (v["notes"] != ""), F.concat(F.lit("\n\n**Notes:**\n"), v["notes"])).otherwise("")
                return F.struct(i.alias("index"), F.get(g["rows"], F.lit(0))["key"].alias("key"), F.concat(v["context"], _block(v["header"], own), tail).alias("markdown"))

            return F.transform(groups, one)

        return let(let(placed, runs), told)

    given = F.struct(header.alias("header"), F.when(some, body).otherwise(F.slice(body, 1, 0)).alias("body"), notes.alias("notes"), context.alias("context"))
    return let(given, grouped)


def pack_rows(header: Column, body: Column, notes: Column, prefix_length: Column, limit: int = TABLE_CHARS) -> Column:
    """The Markdown of the parts of a table, each with the header and as many rows as fit in `limit` characters with the prefix, one at least.

    A fold over the rows' lengths holds the size of the open part and where parts begin; the rows are cut there.
    """

    def packed(v: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("at"))

        def step(s, n):
            over = (v["fixed"] + s["size"] + n > limit) & (s["size"] > 0)
            return F.struct((s["i"] + 1).alias("i"), F.when(over, n).otherwise(s["size"] + n).alias("size"), F.when(over, F.array_append(s["at"], s["i"])).otherwise(s["at"]).alias("at"))

        lengths = F.transform(v["body"], lambda r: F.length(row_text(r)) + 1)
        starts = F.when(F.size(v["body"]) > 0, F.aggregate(lengths, zero, step, lambda s: s["at"])).otherwise(F.array().cast("array<int>"))
        tail = F.when(v["notes"] != "", F.concat(F.lit("\n\n**Notes:**\n"), v["notes"])).otherwise("")
        return let(starts, lambda at: F.transform(_cut(v["body"], at), lambda p, i: F.concat(_block(v["header"], p), F.when(i == F.size(at) - 1, tail).otherwise(""))))

    fixed = prefix_length + F.length(row_text(header)) + F.length(row_text(rule(header))) + 2
    return let(F.struct(header.alias("header"), body.alias("body"), notes.alias("notes"), fixed.alias("fixed")), packed)


def table_markdowns(tables: DataFrame, prefix: Column, limit: int = TABLE_CHARS) -> DataFrame:
    """preprocess()ed tables with `parts`: the whole table's Markdown where it fits, else its parts."""
    t = bound(tables, __whole=markdown(F.col("header"), F.col("body"), F.col("notes")), __room=limit - F.length(prefix))
    whole = F.col("__whole")
    split = pack_rows(F.col("header"), F.col("body"), F.col("notes"), limit - F.col("__room"), limit)
    parts = F.when(F.trim(whole) == "", F.array().cast(EMPTY)).when(F.length(whole) <= F.col("__room"), F.array(whole)).otherwise(split)
    return bound(t, parts=parts).drop("__whole", "__room")
