"""Column functions over texts: normalisation, identifiers, n-grams, token estimates, answer and question tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
_FULL = "".join(chr(c) for lo, hi in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(lo, hi)) + "\u3000"
_HALF = "".join(chr(c - 0xFEE0) for lo, hi in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(lo, hi)) + " "

# Words that refer to an earlier turn, particles, small talk.
REFERENTIAL = (
    "还有", "然后", "继续", "接着", "刚才", "刚刚", "上面", "下面", "之后", "另外", "别的", "其他", "其它", "上一个", "下一个", "这个", "那个", "这些", "那些", "这里", "那里",
    "上一步", "下一步", "那", "这", "它", "他", "她",
)
PARTICLES = "呢吗嘛么呀啊吧哦哈了的地得个"
ORDINAL = "第[0-9一二三四五六七八九十百]+[步条项点章节个]"
SMALLTALK = (
    "hi", "hello", "hey", "你好", "您好", "在吗", "在么", "在不在", "哈喽", "嗨", "谢谢", "谢谢你", "thanks", "thankyou", "ok", "好的", "test", "测试", "ping", "早上好", "下午好",
    "晚上好", "辛苦了", "再见", "拜拜",
)
# What hints at several questions in one.
MULTI_INTENT = ("[和与跟]|以及|还有|或者|及其?", "区别|对比|比较|不同|分别|各自", "从.+到", "、", "[？?].*[？?]")
IMAGE_MARKER = "(?i)(?:<{1,2}|【|《)\\s*IMG\\s*[:：]\\s*\\d+(?:\\.\\d+)?\\s*(?:>{1,2}|】|》)"


def normalize_text(text: Column) -> Column:
    """Drops zero-width characters, narrows full-width letters, digits and space, folds runs of blank lines. Idempotent."""
    narrow = F.translate(F.regexp_replace(text, _ZERO_WIDTH, ""), _FULL, _HALF)
    return F.regexp_replace(narrow, "\\n[ \\t\u3000]*\\n(?:[ \\t\u3000]*\\n)+", "\n\n")


def normalize_question(text: Column) -> Column:
    """Trimmed, lower case, without anything but letters, digits and underscores; null is empty.

    Compatibility forms are folded only for full-width letters and digits; ``quarry.functions.arrow`` has the form
    with full NFKC.
    """
    narrow = F.translate(F.coalesce(text, F.lit("")), _FULL, _HALF)
    return F.regexp_replace(F.lower(F.trim(narrow)), "[^\\p{L}\\p{N}_]+", "")


def question_hash(text: Column) -> Column:
    return F.sha2(normalize_question(text), 256)


def is_junk_question(text: Column, least: int = 2) -> Column:
    """Empty once normalised, shorter than ``least``, or all digits."""
    norm = normalize_question(text)
    return (F.char_length(norm) < least) | norm.rlike("^[0-9]+$")


def strip_referential(norm: Column) -> Column:
    out = F.regexp_replace(norm, ORDINAL, "")
    for token in REFERENTIAL:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.translate(out, PARTICLES, "")


def is_incomplete_question(text: Column, longest: int = 12) -> Column:
    """Short, no junk, and without two characters of its own once references and particles are gone."""
    norm = normalize_question(text)
    return ~is_junk_question(text) & (F.char_length(norm) <= longest) & (F.char_length(strip_referential(norm)) < 2)


def is_noise_turn(text: Column) -> Column:
    return is_junk_question(text) | normalize_question(text).isin(*SMALLTALK)


def has_reference(text: Column) -> Column:
    norm = normalize_question(text)
    return norm.rlike(ORDINAL) | norm.rlike("|".join(REFERENTIAL))


def looks_multi_intent(text: Column, least: int = 8) -> Column:
    """Whether a question of at least ``least`` characters may ask for several things."""
    return F.coalesce((F.char_length(text) >= least) & text.rlike("|".join(MULTI_INTENT)), F.lit(False))


def looks_followup(text: Column, has_history: Column, longest: int = 12) -> Column:
    """Whether a question with turns before it leans on them: it lacks a subject, or refers back and has at most twice ``longest`` characters."""
    leans = is_incomplete_question(text, longest) | (has_reference(text) & (F.char_length(normalize_question(text)) <= 2 * longest))
    return F.coalesce(has_history & ~is_junk_question(text) & leans, F.lit(False))


def strip_image_markers(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE_MARKER, "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", "")


def char_grams(text: Column, n: int) -> Column:
    """The distinct character n-grams of a text without white space; empty if it is shorter than n."""
    bare = without_space(F.coalesce(text, F.lit("")))
    places = F.when(F.char_length(bare) >= n, F.sequence(F.lit(1), F.char_length(bare) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(bare, k, n)))


def gram_containment(needle: Column, hay: Column, n: int = 3) -> Column:
    """Share of the needle's n-grams that the hay holds; 0 if either is shorter than n."""
    a, b = char_grams(needle, n), char_grams(hay, n)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cjk_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\u4e00-\u9fff]"))


def estimate_tokens(text: Column) -> Column:
    """Whole part of (CJK characters / 1.5 + others / 4)."""
    cjk = cjk_chars(text)
    return F.floor(cjk / 1.5 + (F.char_length(text) - cjk) / 4).cast("int")


def chunk_id(doc_id: Column, version: Column, index: Column) -> Column:
    raw = F.concat(doc_id.cast("string"), F.lit("_v"), version.cast("string"), F.lit("_c"), F.lpad(index.cast("string"), 4, "0"))
    return F.concat(raw, F.lit("_"), F.upper(F.substring(F.sha2(raw, 256), 1, 8)))


def stable_pk(key: Column) -> Column:
    """The first eight bytes of the MD5, without the sign bit."""
    signed = F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, -10).cast("long")
    return signed.bitwiseAND(F.lit((1 << 63) - 1))


def title_key(title: Column) -> Column:
    """Lower case, without extension, bracketed parts and punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(title)), "\\.(docx?|xlsx?|pptx?|pdf|txt|md)$", "")
    bare = F.regexp_replace(bare, "[\\(（\\[【《].*?[\\)）\\]】》]", "")
    return F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", "")


def title_similarity(a: Column, b: Column) -> Column:
    """1 if one key holds the other, else the Jaccard index of their bigrams; 0 if either is empty."""
    x, y = title_key(a), title_key(b)
    gx, gy = char_grams(x, 2), char_grams(y, 2)
    union = F.size(F.array_union(gx, gy))
    jaccard = F.when(union > 0, F.size(F.array_intersect(gx, gy)) / union).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(jaccard)


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keywords that the text holds, letter case aside; 1 without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(held / F.size(keywords))


def mask_staff_id(value: Column) -> Column:
    """Two characters at either end of ids over four characters; else stars only."""
    n = F.char_length(value)
    return F.when(value.isNull() | (n == 0), "").when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.lit("***"), F.substr(value, n - 1, F.lit(2))))


def is_prose_table(text: Column) -> Column:
    """A table that is running text: 500 characters of it, three clause marks, cells of 18 characters on average."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    marks = F.regexp_count(clean, F.lit("(?:(?<=\\s)|^)\\d{1,2}[、.][一-龥]")) + F.regexp_count(clean, F.lit("\\d{1,2}\\.\\d{1,2}"))
    cells = F.filter(F.split(clean, "\\s*\\|\\s*"), lambda c: F.trim(c) != "")
    mean = F.aggregate(cells, F.lit(0), lambda acc, c: acc + F.char_length(c)) / F.size(cells)
    return (F.char_length(without_space(clean)) >= 500) & (marks >= 3) & (F.size(cells) > 0) & (mean >= 18)


def flatten_prose_table(text: Column) -> Column:
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, "\\s*\\|\\s*", " ")), "[ \\t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(flat, "(?:(?<=\\s)|^)(\\d{1,2}[、.][一-龥])", "\n$1"), "^\\s+|\\s+$", "")


def native_text_ok(text: Column) -> Column:
    """False if more than 15 % are ``(cid:n)`` marks, more than 10 % replacement or private characters, or under 70 % CJK, ASCII or CJK punctuation."""
    raw = F.coalesce(text, F.lit(""))
    n = F.char_length(raw)
    marked = n - F.char_length(F.regexp_replace(raw, "\\(cid:\\d+\\)", ""))
    bare = F.regexp_replace(F.regexp_replace(raw, "\\(cid:\\d+\\)", ""), "\\s", "")
    m = F.char_length(bare)
    odd = F.regexp_count(bare, F.lit("[\ufffd\ue000-\uf8ff]"))
    plain = F.regexp_count(bare, F.lit("[\\x21-\\x7e\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"))
    return F.when(F.trim(raw) == "", True).when(marked > 0.15 * n, False).when(m == 0, True).when(odd > 0.10 * m, False).otherwise(plain >= 0.70 * m)


def _compared(text: Column) -> Column:
    return without_space(F.translate(F.coalesce(text, F.lit("")), _FULL, _HALF))


def character_error_rate(ref: Column, hyp: Column, longest: int = 20_000) -> Column:
    """Edit distance over the reference's length, white space and full-width forms aside; with an empty reference 0 or 1."""
    a, b = F.substring(_compared(ref), 1, longest), F.substring(_compared(hyp), 1, longest)
    return F.when(F.char_length(a) == 0, F.when(F.char_length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(a, b) / F.char_length(a), 4))


def char_f1(ref: Column, hyp: Column) -> Column:
    """F1 of the two texts' character multisets, white space and full-width forms aside."""
    a, b = _compared(ref), _compared(hyp)
    seen = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))
    common = F.aggregate(seen, F.lit(0), lambda acc, c: acc + F.least(count(a, c), count(b, c)))
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 1.0).otherwise(F.round(2 * common / total, 4))


def docset_hash(ids: Column) -> Column:
    """Twelve hex digits over the sorted distinct ids."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), ","), 256), 1, 12)


def markdown_grid(text: Column) -> Column:
    """Cells of the lines that begin with a bar, trimmed, empty ones kept; lines of dashes are left out."""
    strip = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\r|\\n"), strip), lambda x: x.startswith("|"))
    grid = F.transform(lines, lambda x: F.transform(F.slice(F.split(x, "\\|"), F.lit(2), F.greatest(F.size(F.split(x, "\\|")) - 2, F.lit(0))), strip))
    filled = lambda row: F.filter(row, lambda c: c != "")
    return F.filter(grid, lambda row: (F.size(filled(row)) == 0) | ~F.forall(filled(row), lambda c: c.rlike("^:?-{2,}:?$")))


def table_scores(ref: Column, hyp: Column) -> Column:
    """``cell_f1, grid_exact``: F1 of the multisets of filled cells of two grids, and whether they agree cell by cell."""
    plain = lambda grid: F.transform(grid, lambda row: F.transform(row, _compared))
    a, b = plain(ref), plain(hyp)
    x, y = (F.filter(F.flatten(g), lambda c: c != "") for g in (a, b))
    count = lambda cells, c: F.size(F.filter(cells, lambda v: v == c))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, c: acc + F.least(count(x, c), count(y, c)))
    total = F.size(x) + F.size(y)
    return F.struct(F.when(total == 0, 1.0).otherwise(F.round(2 * shared / total, 4)).alias("cell_f1"), (a == b).alias("grid_exact"))
