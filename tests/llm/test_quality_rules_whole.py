"""References and verdicts of the quality rules against a plain version that keeps everything in memory."""

import math
from collections import Counter

import numpy as np

from tidewright.llm import quality_rules as qr

PROSE = {
    "en": "The river was full of fish and the men who came from the town were glad that it had not been so cold as in the year before, for they had to be on the boats by day.",
    "de": "Der Fluss war voll und die Leute aus der Stadt waren froh, dass es nicht so kalt war wie in dem Jahr zuvor, denn sie sind auch bei Nacht auf den Booten.",
    "fr": "La ville est au bord de la mer et les gens qui sont sur le quai ne sont pas plus de dix, mais ils ont du pain pour une semaine avec ce que la mer leur donne.",
}


def corpus():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(180):
        lang = ["en", "de", "fr"][i % 3]
        words = list(rng.permutation(PROSE[lang].split())) * int(rng.integers(1, 2))
        words += list(rng.choice(PROSE[lang].split(), int(rng.integers(0, 60))))
        if i % 10 == 1:
            words = [w.upper() + "!!" for w in words]
        if i % 10 == 2:
            words = [f"{w}{rng.choice(['###', '$$$', '%%%'])}" for w in words]
        if i % 10 == 3:
            words = words[: int(rng.integers(0, 25))]
        if i % 10 == 4:
            words = [f"x{rng.integers(10**6)}q" for _ in words]
        rows.append((i, " ".join(map(str, words)), lang if i % 17 else "xx", "h"))
    return rows + [(900, None, "en", None), (901, "", None, None), (902, " \n\t", "de", ""), (0, rows[0][1], "en", "h"), (None, rows[6][1], None, None)]


def histograms(text):
    raw = (text or "").encode()
    classes = Counter()
    for c in raw:
        if 0x80 <= c < 0xC0:
            continue
        ch = chr(c)
        if ch in "#*$%&|<>":
            classes[7] += 1
        elif c >= 0xC0:
            classes[6] += 1
        elif ch in ".,;:!?\"'()-":
            classes[4] += 1
        elif ch in " \t\n\x0b\x0c\r":
            classes[3] += 1
        else:
            classes[0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 5] += 1
    common = Counter()
    known = {w for ws in qr.COMMON.values() for w in ws}
    for w in raw.split():
        w = w.lower().strip(b".,;:!?\"'()[]").decode(errors="replace")
        common[w if w in known else None] += 1
    return classes, common


def distance(p, q):
    if not sum(p.values()) or not sum(q.values()):
        return 1.0
    total = 0.0
    for k in set(p) | set(q):
        a, b = p[k] / sum(p.values()), q[k] / sum(q.values())
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(total, 0))


def brute(rows):
    sums = {}
    for _, text, lang, _ in rows:
        counts = qr.measure(text)[0]  # counts have a test of their own
        classes, common = histograms(text)
        if lang in qr.COMMON and not qr.base_failed(counts) and counts[2] <= 0.05 * counts[0] and classes[1] <= 0.3 * (classes[0] + classes[1] + classes[6]):
            c, w = sums.setdefault(lang, (Counter(), Counter()))
            c.update(classes)
            w.update(common)
    out = []
    for i, text, _, _ in rows:
        counts = qr.measure(text)[0]
        classes, common = histograms(text)
        n, kept = counts[0], not qr.base_failed(counts)
        if kept and n >= qr.LEAST_FOR_CLASSES and sums:
            by_word, lang = min((distance(common, sums[k][1]), k) for k in sorted(sums))
            kept = distance(classes, sums[lang][0]) <= qr.MOST_CLASSES + qr.SHORT_CLASSES / n and (n < qr.LEAST_FOR_WORDS or by_word <= qr.MOST_WORDS + qr.SHORT_WORDS / n)
        out.append((i, *counts, qr.base_failed(counts), kept))
    return out


SCHEMA = "doc_id long, text string, lang string, histogram string"


def test_verdicts_equal_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, qr.verdicts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert got == want
    assert {k for *_, k in want} == {True, False}
    assert sum(f for *_, f, _ in want) < sum(not k for *_, k in want)


def test_without_known_languages_the_base_rules_decide(spark):
    rows = [(1, PROSE["en"], "xx", None), (2, "### " * 3 + " ".join(f"a{i}$$" for i in range(40)), None, None), (3, "few words", "yy", None)]
    assert sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in qr.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, False, True), (2, False, True), (3, True, False)]
    assert qr.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text():
    words = [f"w{i % 7919}x{i % 31}" for i in range(300_000)]
    counts, classes, common = qr.measure(" ".join(words))
    assert counts[0] == 300_000 and counts[1] == sum(map(len, words)) and int(common.sum()) == 300_000
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    assert counts[4] == len({j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})
