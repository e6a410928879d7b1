"""Reading an answer out of generated text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tunedata.functions.arrays import let
from tunedata.functions.seeded import seeded_choice
from tunedata.functions.templates import SPACE_CLASS, strip

# --- fixed values: number form, option letters, answer phrases ----------------------
NUMBER_PATTERN = r"-?\d+\.?\d*"
CHOICES = ("A", "B", "C", "D")
FINAL_CHOICE_PATTERN = r"所以答案是(.+?)。"
CHOICE_PATTERNS = (
    r"([ABCD])是正确的",
    r"选项([ABCD])正确",
    r"答案为([ABCD])",
    r"答案是([ABCD])",
    r"答案([ABCD])",
    r"选择([ABCD])",
    r"答案：([ABCD])",
    r"选择答案([ABCD])",
)
ANY_CHOICE_PATTERN = r"[ABCD]"
# ------------------------------------------------------------------------------------


def extract_number(text: Column, marker: str) -> Column:
    """Number given as the answer; infinity where there is none.

    Commas are dropped. After a marker the first number before the next marker counts,
    otherwise the last number of the whole text.
    """
    infinity = F.lit(float("inf"))
    clean = F.replace(text, F.lit(","), F.lit(""))
    pattern = F.lit("(?U)" + NUMBER_PATTERN)
    every = F.regexp_extract_all(clean, pattern, F.lit(0))
    after = F.try_element_at(F.split(clean, "\\Q" + marker + "\\E"), F.lit(2))
    marked = F.try_element_at(F.regexp_extract_all(after, pattern, F.lit(0)), F.lit(1))
    found = F.coalesce(marked, F.try_element_at(every, F.lit(-1)))
    return F.coalesce(found.try_cast("double"), infinity)


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"\p{Punct}+", "")
    return strip(F.regexp_replace(bare, f"[{SPACE_CLASS}]+", " "))


def _first(text: Column, pattern: str, group: int) -> Column:
    """The group in the first match, null without one; the pattern is looked for once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def final_choice(text: Column) -> Column:
    """Letter of the last closing phrase, null unless that phrase names a valid letter."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit("(?d)" + FINAL_CHOICE_PATTERN), F.lit(1)), F.lit(-1))
    return F.when(last.isin(*CHOICES), last)


def first_option_text(text: Column, options: dict[str, Column]) -> Column:
    """Letter of the option whose text occurs first in ``text``.

    At the same place the earlier option wins; options with equal texts answer with the
    last of their letters.
    """
    places = F.array(
        *[
            F.struct(F.instr(text, options[c].cast("string")).alias("at"), F.lit(i).alias("order"),
                     options[c].cast("string").alias("text"))
            for i, c in enumerate(CHOICES)
        ]
    )
    letters = F.array(*[F.lit(c) for c in CHOICES])

    def named(found: Column) -> Column:
        hit = F.array_min(found)
        return F.aggregate(
            found, F.lit(None).cast("string"),
            lambda answer, p: F.when(p["text"] == hit["text"], F.get(letters, p["order"])).otherwise(answer),
        )

    return let(F.filter(places, lambda p: p["at"] > 0), named)


def extract_choice(text: Column, options: dict[str, Column], seed: int, *keys: str) -> Column:
    """Struct ``(answer, direct)``: the chosen letter and whether it came from the closing phrase."""
    final = final_choice(text)
    by_phrase = [_first(text, p, 1) for p in CHOICE_PATTERNS]
    any_letter = _first(text, ANY_CHOICE_PATTERN, 0)
    answer = F.coalesce(
        final, *by_phrase, any_letter, first_option_text(text, options), seeded_choice(list(CHOICES), seed, *keys)
    )
    return F.struct(answer.alias("answer"), final.isNotNull().alias("direct"))


def argmax_choice(first: Column, second: Column) -> Column:
    """Letter with the largest summed logit, the first on ties; null for NaN or infinite sums."""
    sums = F.zip_with(first, second, lambda x, y: x.cast("double") + y.cast("double"))
    bad = F.exists(sums, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    letters = F.array(*[F.lit(c) for c in CHOICES])
    return F.when(~bad, F.element_at(letters, F.array_position(sums, F.array_max(sums)).cast("int")))
