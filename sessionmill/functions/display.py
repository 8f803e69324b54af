"""Display expressions: money, counts, durations, shares, mood.

Everything here takes and returns SQL expression text, to be used in ``expr`` or
``selectExpr``: a page has dozens of these columns, and one text is parsed in
one step where building the same tree call by call takes most of a second.

Fixed-point text follows C's printf, which rounds the exact binary value of the
double (0.15 -> '0.1', 12.25 -> '12.2').  Spark's own formatter rounds the
decimal text half up, so ``fixed`` tells it which side of a tie a value is on.
Display columns belong on result rows, after aggregation.
"""

from __future__ import annotations


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is evaluated once.

    Without it every nested use repeats the whole expression, and a projection
    with a dozen display columns outgrows what the JVM compiles as one method.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def fixed(value: str, places: int) -> str:
    """printf('%.<places>f') of a double."""
    x, scale = f"abs(double({value}))", f"{10**places}D"
    floor = f"floor({x} * {scale})"
    # Distance of x * scale from the tie above the floor.  Splitting x at float
    # precision makes both products exact, so the sign is too; on a tie the tiny
    # odd term sends the result to the even neighbour.
    coarse = f"double(float({x}))"
    beyond_tie = f"({coarse} * {scale} - ({floor} + 0.5D)) + ({x} - {coarse}) * {scale} + pmod({floor}, 2) * 1e-300D"
    # A value at or below the tie goes down by a bit or two, which leaves the
    # digits of any other value as they are.
    nudged = f"if({beyond_tie} <= 0, {x} * {1 - 2**-51!r}D, {x})"
    sign = f"if({value} < 0, '-', '')"
    return f"if(({value}) IS NULL, NULL, concat({sign}, format_string('%.{places}f', {nudged})))"


def money(value: str, places: int = 4) -> str:
    return f"concat('$', {fixed(value, places)})"


def human_count(n: str, largest: str = "B") -> str:
    """1234 -> '1.2K'; ``largest`` caps the unit."""
    steps = [("K", "1e3"), ("M", "1e6"), ("B", "1e9")]
    steps = steps[: [name for name, _ in steps].index(largest) + 1]
    suffix, unit = f"'{steps[-1][0]}'", f"{steps[-1][1]}D"
    for (name, size), (_, next_size) in reversed(list(zip(steps, steps[1:]))):
        unit = f"if(n < {next_size}, {size}D, {unit})"
        suffix = f"if(n < {next_size}, '{name}', {suffix})"
    return _let(n, "n", f"if(n < 1000, string(n), concat({fixed(f'n / {unit}', 1)}, {suffix}))")


def token_breakdown(in_tok: str, out_tok: str, cache_tok: str) -> str:
    parts = (human_count(in_tok), "' in / '", human_count(out_tok), "' out / '", human_count(cache_tok), "' cache'")
    return f"concat({', '.join(parts)})"


def human_duration(seconds: str) -> str:
    """'-', '42s', '3m 5s' or '2h 10m' of whole seconds."""
    return _let(
        seconds,
        "s",
        "CASE WHEN s <= 0 THEN '-' WHEN s < 60 THEN concat(s, 's') "
        "WHEN s < 3600 THEN concat(s div 60, 'm ', s % 60, 's') "
        "WHEN s IS NOT NULL THEN concat(s div 3600, 'h ', (s % 3600) div 60, 'm') END",
    )


def percent(part: str, whole: str) -> str:
    return f"if({whole} = 0, '0%', concat({fixed(_over(f'{part} * 100D', whole), 1)}, '%'))"


def ratio(part: str, whole: str, places: int, empty: str) -> str:
    return f"if({whole} = 0, '{empty}', {fixed(_over(part, whole), places)})"


def money_ratio(part: str, whole: str, places: int = 4) -> str:
    return f"concat('$', {ratio(part, whole, places, '0.' + '0' * places)})"


def round_even(value: str) -> str:
    """Double to whole number, halves to even."""
    return f"bigint(rint({value}))"


def feel_points(severity: str) -> str:
    return f"CASE {severity} WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"


def mood(feel: str) -> str:
    return f"CASE WHEN {feel} = 0 THEN 'calm' WHEN {feel} <= 3 THEN 'irked' WHEN {feel} <= 9 THEN 'frustrated' ELSE 'furious' END"


def _over(part: str, whole: str) -> str:
    """Division that gives NULL, not an error, where a guard has already dealt with zero."""
    return f"({part}) / nullif(double({whole}), 0D)"
