"""What an answer is: a refusal, a leak of sources, steps and images it names; and plain arithmetic."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of refusals, of leaked source lists, marks of images and steps.
REFUSAL = "(抱歉|无法回答|没有找到|未找到|未能找到|无相关|不包含相关|未提及|没有相关)"
STRONG_REFUSAL = "(抱歉[，,。]?\\s*(当前|知识库|未|没有)|知识库中(未|没有)|未找到相关信息|无法回答|没有找到相关|未能找到相关|未提供相关信息)"
SOURCE_LEAK = "(参考来源|资料来源|引用来源|信息来源|参考资料[:：]|来源[:：]\\s*《|出处[:：]\\s*《)"
IMAGE_MARK = "<<IMG:\\s*\\d+\\s*>>"
NUMBERED_STEP = "(?m)^\\s*(?:\\d+[\\.、)]|第[一二三四五六七八九十]+步|步骤\\s*\\d+)"
#: Where a refusal opens an answer, and how long an answer may be that a refusal anywhere makes one.
OPENING, SHORT = 30, 110


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def refuses(text: Column) -> Column:
    """Whether any declining phrase occurs."""
    return _said(text).rlike(REFUSAL)


def refuses_wholly(text: Column) -> Column:
    """Whether a strong phrase opens the answer, or occurs in a short one."""
    a = F.regexp_replace(_said(text), "^\\s+|\\s+$", "")
    at = F.regexp_instr(a, F.lit(STRONG_REFUSAL))
    return (at > 0) & ((at - 1 <= OPENING) | (F.char_length(a) <= SHORT))


def leaks_sources(text: Column) -> Column:
    return _said(text).rlike(SOURCE_LEAK)


def image_marks(text: Column) -> Column:
    return F.regexp_count(_said(text), F.lit(IMAGE_MARK))


def numbered_steps(text: Column) -> Column:
    return F.regexp_count(_said(text), F.lit(NUMBERED_STEP))


_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?%?|//|\*\*|[-+*/%()])")
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4}


class _Sum:
    """Climbs over the precedences of a row of tokens."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def value(self, least: int = 1) -> float:
        head = self.peek()
        if head is None:
            raise ValueError("ends too early")
        self.at += 1
        if head == "(":
            left = self.value()
            if self.peek() != ")":
                raise ValueError("is not closed")
            self.at += 1
        elif head in "+-":
            left = self.value(3) * (-1 if head == "-" else 1)
        elif head[0].isdigit():
            left = float(head.rstrip("%")) / (100 if head.endswith("%") else 1)
        else:
            raise ValueError("no number")
        while (sign := self.peek()) in _BINDS and _BINDS[sign] >= least:
            self.at += 1
            right = self.value(_BINDS[sign] + (sign != "**"))
            left = _apply(sign, left, right)
        return left


def _apply(sign: str, a: float, b: float) -> float:
    if sign in ("/", "//", "%") and b == 0:
        raise ValueError("divides by zero")
    if sign == "**":
        if abs(b) > 8 or abs(a) > 1e6:
            raise ValueError("is too large")
        return a**b
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0.0, "//": a // b if b else 0.0, "%": a % b if b else 0.0}[sign]


def solve(text: str | None) -> float | None:
    """The value of a plain sum of at most 60 characters, an equals sign or a question at its end aside; None for all else."""
    if not text or len(text) > 60:
        return None
    said = re.sub(r"(等于几|等于多少|[=＝])?\s*[?？]?\s*$", "", text.strip()).replace("×", "*").replace("÷", "/")
    tokens, at = [], 0
    while at < len(said.rstrip()):
        m = _TOKEN.match(said, at)
        if not m:
            return None
        tokens.append(m[1])
        at = m.end()
    if not any(t[0].isdigit() for t in tokens) or len(tokens) < 2:
        return None
    try:
        row = _Sum(tokens)
        out = row.value()
        return out if row.peek() is None and isinstance(out, float) and abs(out) < 1e15 else None
    except (ValueError, RecursionError, OverflowError):
        return None


def arithmetic(text: Column) -> Column:
    """``solve`` in Arrow batches."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(solve).astype("float64").astype("Float64")

    return run(text)
