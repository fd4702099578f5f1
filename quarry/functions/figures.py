"""Which figures a step's text refers to, and which of two steps owns an image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.arrow import longest_common_substring

# Circled numbers, what joins a range, and the strengths of ownership.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
JOINS = "[-–—~～至到]"
FIGURE, LOCAL, SPATIAL, BROAD_RANGE, NONE = 4, 3, 2, 1, 0

_MARK = f"[{CIRCLED}]"
_NUMBER = f"{_MARK}|\\d{{1,2}}"
_CIRCLED_RANGE = f"{_MARK}\\s*{JOINS}\\s*{_MARK}"
_PLAIN_RANGE = f"\\d{{1,2}}\\s*{JOINS}\\s*\\d{{1,2}}"
_STEPS = f"(?:图\\s*)?(?:{_CIRCLED_RANGE}|{_PLAIN_RANGE})\\s*步"
_FIGURES = f"{_CIRCLED_RANGE}|图\\s*{_PLAIN_RANGE}"
_SINGLE = f"{_MARK}|图\\s*\\d{{1,2}}"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _numbers(text: Column) -> Column:
    return F.transform(_all(text, _NUMBER), lambda m: F.coalesce(m.try_cast("int"), F.instr(F.lit(CIRCLED), m)))


def step_ranges(text: Column) -> Column:
    """Whether the text names a range of at least three steps, such as ``①-⑥步``; null is empty."""
    found = F.transform(_all(F.coalesce(text, F.lit("")), _STEPS), _numbers)
    return F.exists(found, lambda r: (r[0] > 0) & (r[1] - r[0] >= 2))


def figure_refs(text: Column) -> Column:
    """Sorted numbers of the figures that the text refers to: ranges, circled marks, ``图7``. Ranges of steps are none."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), _STEPS, "  ")
    ranges = F.filter(F.transform(_all(rest, _FIGURES), _numbers), lambda r: r[0] <= r[1])
    single = F.filter(F.flatten(F.transform(_all(F.regexp_replace(rest, _FIGURES, "  "), _SINGLE), _numbers)), lambda n: n >= 1)
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(ranges, lambda r: F.sequence(r[0], r[1]))), single)))


def printed_numbers(recognised: Column) -> Column:
    """Circled numbers in the text recognised on an image."""
    return F.array_sort(F.array_distinct(F.transform(_all(F.coalesce(recognised, F.lit("")), _MARK), lambda m: F.instr(F.lit(CIRCLED), m))))


def common_run(summary: Column, step: Column) -> Column:
    """Length of the longest run that both texts hold, apart from bracketed document prefixes."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "【[^】]*】", "")
    return longest_common_substring(bare(summary), bare(step))


def ownership(step: Column, printed: Column, common: Column, nearby: bool, least: int = 4) -> Column:
    """How strongly a step owns an image: by a figure it names, by ``least`` characters shared, by place, by a range of steps, or not."""
    by_place = F.lit(SPATIAL) if nearby else F.when(step_ranges(step), BROAD_RANGE).otherwise(NONE)
    return F.when(F.arrays_overlap(printed, figure_refs(step)), FIGURE).when(common >= least, LOCAL).otherwise(by_place)


def move_decision(source: Column, target: Column, printed: Column, source_common: Column, target_common: Column, margin: int = 2) -> Column:
    """``apply, decision, reason, source_score, target_score`` for moving an image from the step beside it to another.

    The target must own it more strongly: with figures on both sides by more shared ones, with local matches on both by
    ``margin`` more characters, else by a higher score.
    """
    a, b = ownership(source, printed, source_common, True), ownership(target, printed, target_common, False)
    shared = lambda c: F.size(F.array_intersect(printed, figure_refs(c)))
    apply = F.when((a == FIGURE) & (b == FIGURE), shared(target) > shared(source)).when((a == LOCAL) & (b == LOCAL), target_common >= source_common + margin).otherwise(b > a)
    kept = F.when(a < LOCAL, "ambiguous_kept_at_source").when(step_ranges(target), "range_theft_blocked").otherwise("source_owner_preserved")
    reason = F.when(apply, "stronger_destination_owner").otherwise(kept)
    decision = F.when(apply, "allow").when(reason == "range_theft_blocked", "reject_conflict").otherwise("reject_review")
    return F.struct(apply.alias("apply"), decision.alias("decision"), reason.alias("reason"), a.alias("source_score"), b.alias("target_score"))
