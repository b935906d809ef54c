import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import formulas, ids
from lodestrata.functions import text as X
from lodestrata.functions.vectors import cosine_distance, normalized
from lodestrata.profile import ID_NAMESPACE, Profile


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


CLEAN = [
    ("Downloaded by someone (a@b.c) on Jan 1\nbody", "body"),
    ("a b–c—d−e", "a b-c-d-e"),
    ("‘x’ “y” 5µs ±1 90° ≤ ≥ 2×3…", "'x' \"y\" 5us +/-1 90deg <= >= 2x3..."),
    ("e•MMC", "e*MMC"),
    ("e.MMC and e - MMC", "eMMC and eMMC"),
    ("a \t b\n\n\n\nc", "a b\n\nc"),
    ("x () [ ] ( . )", "x"),
    ("(())", "()"),
    ("∆t Page 12", "Deltat"),
    ("", ""),
]


@pytest.mark.parametrize(("given_text", "expected"), CLEAN)
def test_clean_text(spark, given_text, expected):
    assert one(spark, X.clean_text(F.col("t")), t=given_text) == expected


def test_clean_text_takes_holders(spark):
    own = Profile(watermarks=(r"holder@example\.com", *Profile().watermarks))
    assert one(spark, X.clean_text(F.col("t"), own), t="for HOLDER@example.com only") == "for only"


@pytest.mark.parametrize(("title", "number", "bare"), [("6.10.4 Title", "6.10.4", "Title"), ("Title", "", "Title"), ("6", "6", ""), ("", "", "")])
def test_section_number(spark, title, number, bare):
    assert one(spark, X.section_number(F.col("t")), t=title) == number
    assert one(spark, X.bare_title(F.col("t")), t=title) == bare


def test_section_path(spark):
    assert one(spark, F.array_join(X.section_path(F.col("t")), "/"), t="6.10.4") == "6/6.10/6.10.4"
    assert one(spark, F.size(X.section_path(F.col("t"))), t="") == 0


@pytest.mark.parametrize("label", ["6.1 e•MMC  Bus.", "6.1 e *MMC Bus", "6.1 E-MMC bus"])
def test_labels_agree(spark, label):
    assert one(spark, X.normalize_label(F.col("t")), t=label) == "6.1 emmc bus"


@pytest.mark.parametrize(("q", "found"), [("5.1 and 4.5", ["5.1", "4.51"]), ("B50", ["5.0"]), ("7.5.1", ["5.1"]), ("15.1", []), ("none", []), ("compare 4.51 5.0 5.1", ["5.1", "5.0", "4.51"])])
def test_versions(spark, q, found):
    assert one(spark, X.versions_named(F.col("t")), t=q) == found


def test_target_versions(spark):
    assert one(spark, X.target_versions(F.col("t"), "5.1"), t="bus") == ["5.1"]
    assert one(spark, X.target_versions(F.col("t"), "all"), t="bus") == []


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_uuid5(spark, name):
    if "\x00" in name or any(0xD800 <= ord(c) < 0xE000 for c in name):
        return
    assert one(spark, ids.uuid5(ID_NAMESPACE, F.col("t")), t=name) == str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), name))


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="EXT_CSD[226] naïve") == ["ext_csd", "226", "na", "ve"]


@pytest.mark.parametrize(("m", "tail"), [("0", "= 0 KB  ["), ("7", "= 896 KB  ["), ("8", "= 1024 KB = 1 MB  ["), ("12", "= 1536 KB = 2 MB  ["), ("20", "= 2560 KB = 2 MB  [")])
def test_boot_size(spark, m, tail):
    assert tail in one(spark, formulas.calculate(F.lit("boot_size"), F.create_map(F.lit("boot_size_mult"), F.col("m"))), m=m)


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_fixed_rounds_exact_binary_values(spark, digits):
    """Halves that are exact go to the even digit, those that only look so go where their binary value lies."""
    scale = 2 * 10**digits
    values = [k / scale for k in range(-41, 2000, 2)] + [k * 512e3 / 1e9 for k in range(0, 20000, 625)] + [0.125, 0.375, 2.675, 1.005, 1e15 + 0.5, 1e300, 123456789.015]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "x double").select(formulas.fixed(F.col("x"), digits).alias("s")).collect()]
    assert [g for g, v in zip(got, values, strict=True) if v < 1e300] == [f"{v:.{digits}f}" for v in values if v < 1e300]


def test_capacity_of_an_exact_half(spark):
    row = spark.createDataFrame([(1_220_703_125,)], "n long").select(formulas.sentence("capacity", F.col("n")).alias("s"), formulas.sentence("capacity", F.col("n") * 0 + 5_625_000).alias("h")).first()
    assert f"({1_220_703_125 * 512 / 1e9:.2f} GB)" in row.s and f"({5_625_000 * 512 / 1e9:.2f} GB)" in row.h


def test_calculate_errors(spark):
    bad = lambda name, key, value: one(spark, formulas.calculate(F.lit(name), F.create_map(F.lit(key), F.col("m"))), m=value)
    assert bad("boot_size", "boot_size_mult", "0x10").startswith("Calculation error")
    assert "'boot_size_mult'" in bad("boot_size", "other", "1")
    assert bad("x", "a", "1").startswith("Unknown formula 'x'")


def test_definitions(spark):
    found = one(spark, X.definitions(F.col("t")), t="CMD: a command of the bus\nnot this\nHS200 - high speed interface")
    assert [(d.term, d.definition) for d in found] == [("CMD", "a command of the bus"), ("HS200", "high speed interface")]
    found = one(spark, X.definitions(F.col("t")), t="3.1.1 Block term\nA number of bytes, basic data unit.")
    assert [d.term for d in found] == ["Block term"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(cosine_distance(F.col("a"), F.col("b")).alias("d"), cosine_distance(F.col("a"), F.col("z")).alias("n"), normalized(F.col("a")).alias("u")).first()
    assert abs(row.d - 0.04) < 1e-12 and row.n is None and row.u == [0.6, 0.8]


def test_block_kind(spark):
    assert one(spark, X.block_kind(F.col("t"), F.lit("Bus")), t="field [7:4] R/W") == "register"
    assert one(spark, X.block_kind(F.col("t"), F.lit("Terms of use")), t="field") == "definition"
    assert one(spark, X.block_kind(F.col("t"), F.lit("Bus")), t="[7:4] only") == "text"
