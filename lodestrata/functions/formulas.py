"""Register formulas: integer arithmetic with its rendering as a sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transfer-speed codes (unit in Hz, multiplier).
FREQUENCY = {0: 100e3, 1: 1e6, 2: 10e6, 3: 100e6}
MULTIPLIER = {1: 1.0, 2: 1.2, 3: 1.3, 4: 1.5, 5: 2.0, 6: 2.5, 7: 3.0, 8: 3.5, 9: 4.0, 10: 4.5, 11: 5.0, 12: 5.5, 13: 6.0, 14: 7.0, 15: 8.0}

# Formulas and their parameters.
FORMULAS = {
    "boot_size": ["boot_size_mult"],
    "rpmb_size": ["rpmb_size_mult"],
    "capacity": ["sec_count"],
    "tran_speed": ["freq_unit", "mult"],
    "erase_group": ["hc_erase_grp_size"],
    "wp_group": ["hc_wp_grp_size", "hc_erase_grp_size"],
    "sleep_current": ["s_c_vcc"],
    "gp_size": ["gp_size_mult", "hc_erase_grp_size", "hc_wp_grp_size"],
}


def _s(c: Column) -> Column:
    return c.cast("string")


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _s(p) for p in parts])


def _mega(kb: Column, unit: str) -> Column:
    """" = n MB" from 1024 KB on, rounded half to even."""
    return F.when(kb >= 1024, _say(" = ", F.bround(kb / 1024.0, 0).cast("long"), f" {unit}")).otherwise("")


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals as its exact binary value rounds, an exact half to the even digit (format_string rounds the shortest decimals, half up).

    x is compared with the middle of its last digits: scale x minus an odd number, taken in powers of two from the greatest, is exact in every step
    wherever its sign is in doubt. Numbers that have no such digits, and those that are not finite, are as format_string shows them.
    """
    ten, a = 10**digits, F.abs(x.cast("double"))
    k = F.floor(a * ten).cast("double")
    rest = -(k * 2 + 1)
    for bit in reversed(range((2 * ten).bit_length())):
        if 2 * ten >> bit & 1:
            rest = rest + a * float(1 << bit)
    up = F.when(rest == 0, k % 2 == 1).otherwise(rest > 0)
    units = (k + F.when(up, 1.0).otherwise(0.0)).cast("long")
    shown = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(units / ten).cast("string"), F.lit("."), F.lpad((units % ten).cast("string"), digits, "0"))
    return F.when(a * ten < float(1 << 51), shown).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def kilobytes(name: str, *args: Column) -> Column:
    """The sizes in KB behind the sentences."""
    a = [x.cast("long") for x in args]
    return {
        "boot_size": lambda: a[0] * 128,
        "rpmb_size": lambda: a[0] * 128,
        "erase_group": lambda: (a[0] + 1) * 512,
        "wp_group": lambda: (a[0] + 1) * (a[1] + 1) * 512,
        "gp_size": lambda: a[0] * (a[2] + 1) * (a[1] + 1) * 512,
    }[name]()


def sentence(name: str, *args: Column) -> Column:
    """The rendered result of a formula over long columns, null if a parameter is null."""
    a = [x.cast("long") for x in args]
    if name in ("boot_size", "rpmb_size"):
        kb = kilobytes(name, *a)
        what, where = ("Boot partition size", "[226] BOOT_SIZE_MULT") if name == "boot_size" else ("RPMB partition size (per partition)", "[168] RPMB_SIZE_MULT")
        return _say(f"{what} = 128 KB × ", a[0], " = ", kb, " KB", _mega(kb, "MB"), f"  [EXT_CSD{where}]")
    if name == "capacity":
        total = a[0] * 512
        return _say("Device capacity = SEC_COUNT × 512 bytes = ", a[0], " × 512 = ", F.format_number(total, 0), " bytes ≈ ", fixed(total / float(1 << 30), 2), " GiB (", fixed(total / 1e9, 2), " GB)  [EXT_CSD[215:212] SEC_COUNT]")
    if name == "tran_speed":
        # decimals as exact binary values round, so the few results are rendered when the plan is made
        shown = {k * 16 + m: f"{u * v / 1e6:.1f}" for k, u in FREQUENCY.items() for m, v in MULTIPLIER.items()}
        look = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c.cast("int"))
        base, mult = look({k: f"{u / 1e6:.1f}" for k, u in FREQUENCY.items()}, a[0]), look({m: str(v) for m, v in MULTIPLIER.items()}, a[1])
        good = _say("TRAN_SPEED decode: freq_unit=", a[0], " → ", base, " MHz base, mult=", a[1], " → ×", mult, "\nResult = ", base, " × ", mult, " = ", look(shown, a[0] * 16 + a[1]), " MHz  [CSD[103:96] TRAN_SPEED]")
        keys = lambda d: "[" + ", ".join(map(str, d)) + "]"
        return (
            F.when(a[0].isNull() | a[1].isNull(), F.lit(None))
            .when(base.isNull(), _say("Invalid freq_unit=", a[0], f". Valid values: {keys(FREQUENCY)}."))
            .when(mult.isNull(), _say("Invalid mult=", a[1], f". Valid values: {keys(MULTIPLIER)}."))
            .otherwise(good)
        )
    if name == "erase_group":
        kb = kilobytes(name, *a)
        return _say("Erase group size = (HC_ERASE_GRP_SIZE + 1) × 512 KB = (", a[0], " + 1) × 512 = ", kb, " KB", _mega(kb, "MiB"), "  [EXT_CSD[224] HC_ERASE_GRP_SIZE]")
    if name == "wp_group":
        kb = kilobytes(name, *a)
        return _say("Write protect group size = (HC_WP_GRP_SIZE + 1) × erase_group_size = (", a[0], " + 1) × ", (a[1] + 1) * 512, " KB = ", kb, " KB", _mega(kb, "MiB"), "  [EXT_CSD[221] HC_WP_GRP_SIZE]")
    if name == "sleep_current":
        ua = F.when(a[0].between(0, 62), F.pow(F.lit(2.0), a[0]).cast("long"))
        return _say("Sleep mode max current = 1 µA × 2^(S_C_VCC) = 1 × 2^", a[0], " = ", ua, " µA  [EXT_CSD[143] S_C_VCC]")
    if name == "gp_size":
        kb = kilobytes(name, *a)
        return _say("GP partition size = GP_SIZE_MULT × wp_group_size = ", a[0], " × ", (a[2] + 1) * (a[1] + 1) * 512, " KB = ", kb, " KB", _mega(kb, "MiB"), "  [EXT_CSD[154:143] GP_SIZE_MULT]")
    raise KeyError(name)


def calculate(formula: Column, parameters: Column) -> Column:
    """The sentence for rows of (formula name, map of parameters as strings); error texts for unknown names and bad parameters."""
    name_of = F.lower(F.trim(formula))
    out = F.lit(None).cast("string")
    error = lambda name, what: _say(f"Calculation error for formula '{name}': ", what, ". Check parameter names and types.")
    for name, needed in FORMULAS.items():
        given = [F.trim(F.element_at(parameters, F.lit(p))) for p in needed]
        args = [x.try_cast("long") for x in given]
        text = sentence(name, *args)
        for p, x, n in reversed([*zip(needed, given, args, strict=True)]):  # the first that is wrong is told
            text = F.when(x.isNull(), error(name, F.lit(f"'{p}'"))).when(n.isNull(), error(name, _say("invalid literal for int() with base 10: '", x, "'"))).otherwise(text)
        out = F.when(name_of == name, text).otherwise(out)
    names = "[" + ", ".join(f"'{x}'" for x in FORMULAS) + "]"
    return F.when(name_of.isin(list(FORMULAS)), out).otherwise(_say("Unknown formula '", F.coalesce(name_of, F.lit("null")), f"'. Supported: {names}."))


def round_tenth(x: Column) -> Column:
    """x (from 0 to 2**48) to one decimal as its exact binary value rounds, an exact half to the even digit.

    x is compared with the middle of its tenths: 20 x minus an odd number is exact in two steps wherever its sign is in doubt.
    """
    k = F.floor(x * 10).cast("double")
    above = (x * 16 - (k * 2 + 1)) + x * 4
    up = F.when(above == 0, k % 2 == 1).otherwise(above > 0)
    return (k + F.when(up, 1.0).otherwise(0.0)) / 10
