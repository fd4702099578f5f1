from __future__ import annotations

import hashlib
import random
import re


from quarry.llm import pii
from quarry.llm.queries import op6_personal_data


def plain(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(5)
    parts = ["1", "2", "0", "9", "255", "256", ".", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "x@y.com", "\n", "é", "𝄞", "+1 (555) 123-4567"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert plain(t) == pii.base_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a.b-" * 100_000 + "@", "+1" * 100_000, "1.1." * 100_000):
        assert pii.base_spans(t) == [] or len(t) > 0


def test_query(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op6_personal_data(spark, data).collect():
        base = plain(docs[r["doc_id"]])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert hashlib.sha256(said.encode()).hexdigest() == r["base_sha256"]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_bootstrap_finds_what_stands_in_known_contexts(spark):
    rng = random.Random(1)
    prose = ["alpha", "beta", "gamma", "delta", "of", "the"]
    line = lambda v: f"{' '.join(rng.choices(prose, k=8))} contact phone: {v} {' '.join(rng.choices(prose, k=8))}"
    rows = [(k, line(f"+1 555 {k:03d} {4000 + k}")) for k in range(60)] + [(100, line("0555-998877"))] + [(200 + k, f"order {10_000 + k} of the beta") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert got[100]["n_context"] == 1 and "context:" in got[100]["spans"]
    assert all(got[200 + k]["spans"] == "" for k in range(60))
    assert all(got[k]["n_phone"] == 1 for k in range(60))


def test_odd_rows(spark, odd, none):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_personal_data(none).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1!"), (2, None), (3, "clean")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.find_personal_data(docs)).collect()}
    assert out == {1: "mail [email] or [ip]!", 2: None, 3: "clean"}


def plain_bootstrap(texts):
    """All spans by the method in plain Python, patterns as strings: ``text: spans``."""
    from collections import Counter, defaultdict
    from math import prod

    bare = lambda w: re.sub("[0-9]", "0", w.lower())
    hits, seen, follow, held = Counter(), defaultdict(dict), Counter(), []
    for t in texts:
        words = [(m[0], m.start()) for m in re.finditer(r"\S+", t)]
        for k, (w, _) in enumerate(words[1:], 1):
            opening = w[: len(w) - len(w.lstrip(pii._EDGES))]
            follow[bare(words[k - 1][0]), opening] += 1
            if k > 1:
                follow[bare(words[k - 2][0]), bare(words[k - 1][0]), opening] += 1
        base = pii.base_spans(t)
        own = []
        for s, kind, e in base + pii.other_spans(t, base):
            before = t[:s]
            left = before.rstrip(pii._EDGES)
            opening, names = before[len(left) :], []
            if left and left[-1].isspace():
                last = [bare(w) for w in left.split()[-2:]]
                names = [(*last[-1:], opening), *([(*last, opening)] if len(last) == 2 else [])] if last else []
            for n in names:
                hits[n] += 1
                seen[n][t[s:e]] = max(seen[n].get(t[s:e], 0.0), float(kind < 5))
            own.append((s, kind, e, names))
        held.append(own)
    precise = {n: x for n, x in seen.items() if len(x) >= pii.SUPPORT and hits[n] >= pii.PRECISION * follow[n] > 0}
    value, good = {n: dict(x) for n, x in precise.items()}, {}
    for _ in range(pii.ROUNDS):
        before = len(good)
        good = {n: sum(x.values()) / (len(x) + 1) for n, x in value.items()}
        good = {n: c for n, c in good.items() if c >= pii.CONFIDENCE - 1e-9 and sum(value[n].values()) >= pii.SUPPORT - 1e-9}
        if len(good) == before:
            break
        reach = defaultdict(list)
        for n, c in good.items():
            for i in precise[n]:
                reach[i].append(c)
        value = {n: {i: max(seed, 1 - prod(1 - c for c in reach[i])) for i, seed in x.items()} for n, x in precise.items()}
    return [",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, names in sorted(own) if k < 5 or any(n in good for n in names)) for own in held]


def corpus(rng):
    prose = "alpha beta gamma delta of the on with under about".split()
    some = lambda n: " ".join(rng.choices(prose, k=n))
    badge = [f"QX-{rng.randrange(10**6, 10**7)}" for _ in range(60)]
    locker = [f"L{rng.randrange(10**7, 10**8)}" for _ in range(60)]
    rows = [f"{some(8)} contact id: +1 555 {k:03d} {4000 + k} {some(6)}" for k in range(60)]
    rows += [f"{some(8)} Contact ID: {b} {some(6)}" for b in badge[:40]]
    rows += [f"{some(8)} badge no. ({b}) {some(6)}" for b in badge]  # one hop: half of them are known from above
    rows += [f"{some(4)} badge no. ({x}) {some(4)}" for x in locker[:20]] + [f"{some(8)} locker = {x} {some(6)}" for x in locker]  # two hops
    rows += [f"{some(3)} order {rng.randrange(10**5, 10**6)} of {some(3)}" for _ in range(80)]  # never beside anything known
    rows += [f"{some(5)} {rng.randrange(10**5, 10**6)} {some(3)}" for _ in range(40)] + [some(30) for _ in range(200)]
    rng.shuffle(rows)
    return rows, badge, locker


def test_bootstrap_against_plain_python_and_by_recall(spark):
    rows, badge, locker = corpus(random.Random(11))
    docs = spark.createDataFrame(list(enumerate([*rows, *rows[:9]])), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert [got[k] for k in range(len(rows) + 9)] == plain_bootstrap([*rows, *rows[:9]])
    planted = [(k, m) for k, t in enumerate(rows) for m in re.finditer("|".join(map(re.escape, badge + locker)), t)]
    caught = sum(f"context:{m.start()}:{m.end()}" in got[k].split(",") for k, m in planted)
    assert caught >= 0.9 * len(planted)
    assert not any("context" in got[k] for k, t in enumerate(rows) if "order" in t)


def test_what_is_found_does_not_depend_on_unrelated_documents(spark):
    rows, _, _ = corpus(random.Random(11))
    more = [f"write mail to w{k}@ex{k}.com today" for k in range(4000)]
    got = [{r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(x)), "doc_id long, text string")).collect()} for x in (rows, rows + more)]
    assert all(got[1][k] == x for k, x in got[0].items())


def test_long_tokens_and_contexts_are_whole(spark):
    secret = "0af9" * 84
    rows = [(1, f'token = "{secret}" end'), (2, "x" * 500 + " key " + "f1" * 66), *[(10 + k, f"{'w' * 300}{k % 2} {'v' * 400} A{k:06d} z") for k in range(6)], *[(30 + k, f"{'w' * 300}1 {'v' * 400} {k}@a.com") for k in range(8)]]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"secret:9:{9 + len(secret)}" and got[2] == f"secret:505:{505 + 132}"
    assert all(got[10 + k] == "context:703:710" for k in range(6))


def test_copies_of_an_edge_count_once(spark):
    docs = spark.createDataFrame([(k, "please write to: x@y.com now, write to: A123456") for k in range(50)], "doc_id long, text string")
    assert all("context" not in r["spans"] for r in pii.find_personal_data(docs).collect())
