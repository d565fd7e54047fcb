"""Learning, quotation and scores against plain versions over all words, and the sample without copies."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import toxicity as tx
from tidewright.llm.toxicity import Automaton, Lexicon, Scanner


def corpus(n=500, seed=3):
    """Documents of invented words; toxic ones hold one of two words, or several forms of a stem."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    draw = lambda k: "".join(rng.choice(syllables, k))
    pool = [draw(int(rng.integers(2, 4))) for _ in range(700)]
    docs = []
    for i in range(n):
        words = [str(w) for w in rng.choice(pool, int(rng.integers(20, 90)))]
        kind = i % 12
        if kind == 0:
            words[3] = "wretcho,"
        elif kind == 1:
            words[5] = "Scumble!"
        elif kind == 2:
            words[1:6] = [f"vequ{draw(1)}" for _ in range(5)]
        elif kind == 3 and i % 5 == 0:
            words[2] = f"vequ{draw(1)}"  # once, in a clean document
        docs.append((i, " ".join(words), kind in (0, 1, 2)))
    return docs


def brute(docs):
    """{term: (is a stem, worth of few, worth of many)} by counting everything."""
    def words(text):
        return {w for t in set(text.lower().split()) if len(w := re.sub(r"^[^a-z]+|[^a-z]+$", "", t)) >= 3}

    rows = [(words(t), x) for _, t, x in docs]
    toxic = sum(x for _, x in rows)
    clean = len(rows) - toxic
    bads, goods = (sum(len(w) for w, x in rows if x == k) for k in (True, False))
    part = bads / (bads + goods)
    limit = math.log(tx.MOST_CHANCE / len(set().union(*[w for w, _ in rows])))

    def unlikely(b, g):
        n = b + g
        return b > 0 and math.log(sum(math.comb(n, k) * part**k * (1 - part) ** (n - k) for k in range(b, n + 1))) <= limit

    share = lambda b, g, bs, gs: (b / bs) / (b / bs + g / gs) if b else 0.0
    count = {k: Counter(w for ws, x in rows if x == k for w in ws) for k in (True, False)}
    out = {}
    for w, b in count[True].items():
        g = count[False][w]
        if b >= tx.LEAST_DOCS and unlikely(b, g) and share(b, g, toxic, clean) >= tx.LEAST_SHARE:
            out[w] = (False, tx.worth(b, g), tx.worth(b, g))
    held = defaultdict(list)
    for ws, x in rows:
        for stem in {w[:n] for w in ws for n in tx.STEM_LETTERS if n < len(w)}:
            k = sum(w.startswith(stem) and len(w) > len(stem) for w in ws)
            held[stem].append((x, k, k > 1 and k >= tx.DENSE * len(ws)))
    passing = {}
    for stem, found in held.items():
        b, g = (sum(k for x, k, _ in found if x == c) for c in (True, False))
        forms = {w for w in count[True] if w.startswith(stem) and len(w) > len(stem)}
        few_bad, few_good, many_bad, many_good = (sum(x == c and many == m for x, _, many in found) for m in (False, True) for c in (True, False))
        if many_bad >= tx.LEAST_DOCS and len(forms) >= tx.LEAST_FORMS and unlikely(b, g) and share(b, g, bads, goods) >= tx.STEM_SHARE and share(many_bad, many_good, toxic, clean) >= tx.STEM_SHARE:
            passing[stem] = (b, tx.worth(few_bad, few_good), tx.worth(many_bad, many_good))
    for stem in sorted(passing, key=len):
        if any(len(t) == len(stem) + 1 and t.startswith(stem) and passing[t][0] >= tx.NEARLY_ALL * passing[stem][0] for t in passing):
            continue
        if not any(s and stem.startswith(t) for t, (s, *_) in out.items()):
            out[stem] = (True, passing[stem][1], max(passing[stem][1:]))
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, toxic boolean")


def test_lexicon_equals_brute_force(spark):
    docs = corpus()
    lexicon = tx.learn(frame(spark, docs).repartition(3))
    want = brute(docs)
    assert {"wretcho", "scumble", "vequ"} <= set(want)
    got = {t: (s, w, m) for (t, s, w, _), m in zip(lexicon.terms, lexicon.more, strict=True)}
    assert set(got) == set(want)
    for term, (stem, few, many) in want.items():
        assert got[term][0] == stem and np.allclose(got[term][1:], (few, many)), term
    for i, (term, stem, _, _) in enumerate(lexicon.terms):
        covered = not stem and term.startswith("vequ")
        assert (lexicon.terms[lexicon.of[i]][0] == "vequ") == (covered or term == "vequ")


def test_ordinary_variants_turn_edits_off(spark):
    docs = corpus()
    docs = [(i, t + " wretchy" if i % 12 == 7 else t, x) for i, t, x in docs]
    terms = {t: fuzzy for t, _, _, fuzzy in tx.learn(frame(spark, docs)).terms}
    assert not terms["wretcho"] and terms["scumble"]


def test_one_kind_of_label_or_no_words_give_no_terms(spark):
    assert tx.learn(frame(spark, [(1, "a b", True), (2, "wretcho", True)])).terms == []
    assert tx.learn(frame(spark, [(1, None, True), (2, "", False)])).terms == []
    assert tx.learn(frame(spark, [])).terms == []


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_score(lexicon, text):
    tokens = (text or "").lower().split()
    forms, exact, quoted = defaultdict(set), set(), 0.0
    for i, token in enumerate(tokens):
        word = token.strip(tx._TRIM)
        ranks = [(0 if s else 1, k, False) for k, (t, s, _, _) in enumerate(lexicon.terms) if (word.startswith(t) if s else word == t)]
        ranks += [(2, k, True) for k, (t, s, _, f) in enumerate(lexicon.terms) if not s and f and word != t and within_one(word, t)]
        if not ranks:
            continue
        _, k, edited = min(ranks)
        of = lexicon.of[k]
        before, after = tokens[max(0, i - 4) : i + 1], tokens[i : i + 5]
        marks = any(t[0] in tx.OPENING for t in before) and any(t.rstrip(".,;:!?")[-1:] in tx.CLOSING and len(t) > 1 for t in after)
        reports = any(t.strip(tx._TRIM) in tx.REPORTING for t in tokens[max(0, i - 2) : i])
        address = any(t.strip(tx._TRIM) in tx.ADDRESSING for t in tokens[max(0, i - 4) : i + 5])
        if 2 * marks + reports - address >= 1:
            quoted = max(quoted, lexicon.terms[of][2] * (tx.EDITED if edited else 1) * tx.QUOTED)
        else:
            forms[of].add(word)
            exact |= set() if edited else {of}
    size = len({w for t in tokens if len(w := t.strip(tx._TRIM)) >= 3})
    miss = 1.0
    for of, found in forms.items():
        many = len(found) >= 2 and len(found) / max(size, 1) >= tx.DENSE
        miss *= 1 - (lexicon.more[of] if many else lexicon.terms[of][2]) * (1 if of in exact else tx.EDITED)
    return max(1 - miss, quoted)


def test_scores_equal_brute_force():
    rng = np.random.default_rng(8)
    terms = [("clatter", False, 0.9, True), ("mopes", False, 0.8, False), ("vequ", True, 0.3, False), ("vequta", False, 0.85, True), ("zast", True, 0.1, False)]
    lexicon = Lexicon(terms, [0.9, 0.8, 0.95, 0.85, 0.9], [0, 1, 2, 2, 4])
    words = ["clatter", "clater", "Clatters!", "mopes", "mope", "vequx", "vequta", "vekuta", "zasto", "zasti", "you", "said", "word", '"', '"so', 'there"', "«a", "b»", "fine", "day", "the", "boats", "harbour", "quay", "..."]
    for _ in range(1500):
        text = " ".join(rng.choice(words, int(rng.integers(0, 14))))
        if rng.random() < 0.1:
            text += " " + " ".join(f"long{i}" for i in range(1500))
        assert math.isclose(Scanner(lexicon).score(text), brute_score(lexicon, text), abs_tol=1e-12), text


def test_many_tables_match_as_one():
    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abcdé"), n))
    terms = sorted({draw(int(rng.integers(3, 7))) for _ in range(60)})
    lexicon = Lexicon([(t, i % 9 == 0, 0.9, i % 9 != 0 and i % 2 == 0) for i, t in enumerate(terms)])
    words = [draw(int(rng.integers(0, 9))) for _ in range(3000)]
    one, many = Automaton(lexicon, 10**6), Automaton(lexicon, 7)
    assert len(many.tables) > 5
    kind = lambda rows: [(i >= 0 and lexicon.terms[i][1], e, i >= 0) for i, e in rows.tolist()]
    assert kind(one.match(words)) == kind(many.match(words))


def test_a_lexicon_of_thousands_of_terms():
    terms = sorted({f"w{i * 7919 % 100003:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)})
    found = Automaton(Lexicon([(t, False, 0.9, False) for t in terms])).match(terms)
    assert found[:, 0].tolist() == list(range(len(terms)))


@pytest.mark.parametrize("opening", [0, 30])
def test_only_copies_leave_the_sample(spark, opening):
    rng = np.random.default_rng(2)
    start = [f"o{i}" for i in range(opening)]
    texts = [" ".join(start + [f"w{x}" for x in rng.integers(0, 5000, 120)]) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (101, texts[4] + " end"), (102, None), (103, "")]
    labels = [(i, i % 2) for i, _ in docs] + [(0, 1), (0, 1), (3, None), (None, 1)]
    kept = tx.labelled_sample(spark.createDataFrame(docs + [(7, texts[7]), (None, "x")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    ids = [r["doc_id"] for r in kept]
    import zlib

    learnable = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(ids) == [i for i in learnable if not (i == 100 and 3 in learnable) and not (i == 101 and 4 in learnable)]
    assert [r["toxic"] for r in kept if r["doc_id"] == 0] in ([True], [])
