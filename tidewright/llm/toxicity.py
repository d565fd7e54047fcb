"""Toxicity: a learned lexicon, a Levenshtein automaton over its trie, and a context window."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkit import mix64, text_steps, word_bounds, word_hashes
from tidewright.storage import written

#: Labelled documents that the lexicon is learned from, at most: those whose hashed ids come first. A fit's bound, not a corpus bound.
SAMPLE = 12_000
#: Two texts of the sample are copies if this share of their 5-word shingles is the same, as estimated from MINIMA orders; candidates share one of the first FIRST minima.
COPY_SHARE, MINIMA, FIRST, SHINGLE = 0.5, 64, 8, 5
#: A term's count in toxic documents may come about by chance, for one that isn't toxic, with this probability over the number of all words.
MOST_CHANCE = 0.01
#: The least share of toxic documents, counted as if both classes were equally large, of those with a word; of those with many forms of a stem, and of the forms themselves.
LEAST_SHARE, STEM_SHARE = 0.97, 0.9
#: Shorter words aren't terms.
LEAST_LETTERS = 3
#: A stem has 3 to 8 letters, stands for at least so many different words, and at least so many toxic documents hold many of them.
STEM_LETTERS, LEAST_FORMS, LEAST_DOCS = range(3, 9), 3, 2
#: Two or more forms of a stem count as many if they are at least this share of a document's different words; a long text may hold two by chance.
DENSE = 0.003
#: A stem gives way to one that is a letter longer and has this share of its forms.
NEARLY_ALL = 0.9
#: A clean document counts as half a toxic one in a term's worth, and so many clean ones are added.
CLEAN_WEIGHT, PRIOR = 0.5, 0.3
#: Letters that a whole word needs to be looked for with one edit, and the share of clean documents that may hold such a variant.
FUZZY_LETTERS, INNOCENT = 5, 0.001
#: Terms of one table of the automaton; more terms take more tables.
TABLE_TERMS = 300
#: What a hit in quotation, or one edit away, is worth of a direct one.
QUOTED, EDITED = 0.3, 0.85
#: Tokens on each side of a hit that are searched for signs of quotation or of abuse.
WINDOW = 4
THRESHOLD = 0.7
CACHE = 400_000

#: Marks that open and close quotations; words that report speech or speak about a word; words that address someone.
OPENING = "\"'“„«‹‚‘»"
CLOSING = "\"'”“»›’‘«"
REPORTING = frozenset("said says called calls wrote quote quoted quoting word term slur phrase sagte nannte schrieb zitat wort dit appelé écrit mot citation dijo llamó escribió palabra cita".split())
ADDRESSING = frozenset("you your you're du dich dein ihr tu te ton ta vous tú usted ustedes".split())

_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "“”„«»‹›‚‘’…–—¡¿"


@dataclass
class Lexicon:
    """Terms in natural order: (letters, is a stem, worth, may be one edit away).

    more is what many forms of a term are worth together, of the term whose
    forms a term counts among: its stem, or itself. Both may be left out.
    """

    terms: list[tuple[str, bool, float, bool]] = field(default_factory=list)
    more: list[float] = field(default_factory=list)
    of: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.more = self.more or [t[2] for t in self.terms]
        self.of = self.of or list(range(len(self.terms)))


class Automaton:
    """The automata of all terms, as tables of TABLE_TERMS terms each, so that any number of terms takes time in proportion."""

    def __init__(self, lexicon: Lexicon, table_terms: int = TABLE_TERMS) -> None:
        self.stem = np.array([t[1] for t in lexicon.terms], bool)
        self.tables = [(i, Table(lexicon.terms[i : i + table_terms])) for i in range(0, len(lexicon.terms), table_terms)]

    def match(self, words: list[str]) -> np.ndarray:
        """(n, 2): the term's number, or -1, and the edits, for each word: stems first, then whole words, then those one edit away."""
        best = np.tile(np.array([[-1, 0]], np.int64), (len(words), 1))
        rank = np.full(len(words), 3)
        for first, table in self.tables:
            found = table.match(words).astype(np.int64)
            hit = found[:, 0] >= 0
            found[hit, 0] += first
            own = np.where(hit, np.where(self.stem[np.maximum(found[:, 0], 0)], 0, 1 + found[:, 1]), 3)
            better = own < rank
            best[better], rank[better] = found[better], own[better]
        return best


class Table:
    """The Levenshtein automata of some terms, intersected with their trie and made deterministic.

    A state is a set of (trie node, edits). Whole words may be one insertion,
    deletion or substitution away if their term allows it; stems match exactly,
    and whatever follows a stem matches. States are numbered in a dense table,
    so that many words advance one character at a time together.
    """

    def __init__(self, terms: list[tuple[str, bool, float, bool]]) -> None:
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}
        stems: dict[int, int] = {}
        fuzzy_below: list[bool] = [False]
        for i, (term, is_stem, _, fuzzy) in enumerate(self.terms):
            node = 0
            fuzzy_below[0] |= fuzzy
            for c in term:
                if c not in children[node]:
                    children.append({})
                    fuzzy_below.append(False)
                    children[node][c] = len(children) - 1
                node = children[node][c]
                fuzzy_below[node] |= fuzzy
            (stems if is_stem else whole)[node] = i
        letters = sorted({c for t in self.terms for c in t[0]})
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        edited = lambda node: {(n, 1) for n in children[node].values() if fuzzy_below[n]}

        def closed(states: set) -> frozenset:
            return frozenset(states | {x for n, e in states if e == 0 for x in edited(n)})

        def step(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for n, e in states:
                if c in children[n] and (e == 0 or fuzzy_below[children[n][c]]):
                    out.add((children[n][c], e))
                if e == 0 and fuzzy_below[n]:
                    out.add((n, 1))
                    out |= edited(n)
            return closed(out)

        start = closed({(0, 0)})
        number, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
        accept, rows = [], 0
        absorbing: dict[int, int] = {}
        while rows < len(order):
            states, row = order[rows], []
            rows += 1
            for c in [None, *letters]:
                to = step(states, c)
                hit = [stems[n] for n, e in to if e == 0 and n in stems]
                key = ("stem", hit[0]) if hit else to
                if key not in number:
                    number[key] = len(order)
                    order.append(frozenset() if hit else to)
                    if hit:
                        absorbing[number[key]] = hit[0]
                row.append(number[key])
            if rows - 1 in absorbing:
                row = [rows - 1] * len(row)
            table.append(row)
            best = min(((e, whole[n]) for n, e in states if n in whole and (e == 0 or self.terms[whole[n]][3])), default=None)
            accept.append((absorbing[rows - 1], 0) if rows - 1 in absorbing else (best[1], best[0]) if best else (-1, 0))
        self.table = np.array(table, np.int32)
        self.accept = np.array(accept, np.int32)
        self.absorbing = np.zeros(len(order), bool)
        self.absorbing[list(absorbing)] = True

    def match(self, words: list[str]) -> np.ndarray:
        """(n, 2): the term's number, or -1, and the edits, for each word."""
        state = np.ones(len(words), np.int64)
        if words and len(self.codes):
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
            classes = np.where(self.codes[found] == chars, found + 1, 0)
            live = np.arange(len(words))
            at = 0
            while len(live):
                live = live[lengths[live] > at]
                state[live] = self.table[state[live], classes[starts[live] + at]]
                live = live[(state[live] != 0) & ~self.absorbing[state[live]]]
                at += 1
        elif words:
            return np.tile(np.array([[-1, 0]], np.int32), (len(words), 1))
        return self.accept[state]


class Scanner:
    """Finds the hits of a lexicon in texts; remembers what it has said of words, within CACHE."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = Automaton(lexicon)
        self.known: dict[str, tuple[int, int, str] | None] = {}

    def hits(self, text: str | None) -> list[tuple[int, int, str, bool]]:
        """(term, edits, form, in quotation) for each hit of the whole text."""
        if not text or not self.lexicon.terms:
            return []
        tokens = text.lower().split()
        distinct = set(tokens)
        if fresh := [t for t in distinct if t not in self.known]:
            if len(self.known) > CACHE:
                self.known.clear()
                fresh = list(distinct)
            forms = [t.strip(_TRIM) for t in fresh]
            said = self.automaton.match(forms).tolist()
            self.known.update(zip(fresh, ((i, e, form) if i >= 0 else None for (i, e), form in zip(said, forms, strict=True)), strict=True))
        bad = {t: m for t in distinct if (m := self.known[t])}
        if not bad:
            return []
        return [(*bad[t], self.quoted(tokens, i)) for i, t in enumerate(tokens) if t in bad]

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """Whether signs of quotation around token i outweigh those of abuse.

        Marks that open before it and close after it within the window count 2,
        a word that reports speech or names the word counts 1 if it stands
        right before the hit or one token earlier, an address to someone in the
        window counts against it.
        """
        window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        opens = any(t[0] in OPENING for t in tokens[max(0, i - WINDOW) : i + 1])
        closes = any(t.rstrip(".,;:!?")[-1:] in CLOSING and len(t) > 1 for t in tokens[i : i + WINDOW + 1])
        words = [t.strip(_TRIM) for t in window]
        reported = any(t.strip(_TRIM) in REPORTING for t in tokens[max(0, i - 2) : i])
        return 2 * (opens and closes) + reported - any(w in ADDRESSING for w in words) >= 1

    def score(self, text: str | None) -> float:
        """1 - the product of (1 - worth) over terms with direct hits, or the best quoted hit's share if that is more.

        A stem is worth more if many different forms of it are hit; a term that
        is hit one edit away only, less.
        """
        forms: dict[int, set[str]] = defaultdict(set)
        exact, quoted = set(), 0.0
        for term, edits, form, in_quotes in self.hits(text):
            if in_quotes:
                quoted = max(quoted, self.lexicon.terms[self.lexicon.of[term]][2] * (EDITED if edits else 1.0) * QUOTED)
            else:
                forms[self.lexicon.of[term]].add(form)
                if not edits:
                    exact.add(self.lexicon.of[term])
        miss, words = 1.0, n_words(text) if any(len(f) > 1 for f in forms.values()) else 0
        for term, found in forms.items():
            many = len(found) > 1 and len(found) >= DENSE * words
            miss *= 1 - (self.lexicon.more[term] if many else self.lexicon.terms[term][2]) * (1.0 if term in exact else EDITED)
        return max(1 - miss, quoted)


def n_words(text: str) -> int:
    """Number of different words of LEAST_LETTERS letters or more."""
    return len({w for t in set(text.lower().split()) if len(w := t.strip(_TRIM)) >= LEAST_LETTERS})


def log_chance(hits: int, trials: int, share: float) -> float:
    """The logarithm of the chance of at least so many hits, each with that share."""
    log_of = lambda k: math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(share) + (trials - k) * math.log1p(-share)
    logs = [log_of(k) for k in range(hits, min(trials, hits + 200) + 1)]
    return max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))


def worth(bad: int, good: int) -> float:
    return bad / (bad + CLEAN_WEIGHT * good + PRIOR)


def _heads(words: DataFrame) -> DataFrame:
    """words with a row for each stem that a word may have: its first letters, fewer than all."""
    heads = F.transform(F.filter(F.array(*[F.lit(n) for n in STEM_LETTERS]), lambda n: n < F.length("word")), lambda n: F.substring("word", F.lit(1), n))
    return words.select("*", F.explode(heads).alias("stem"))


def stems_of(candidates: dict[str, int], told: dict[str, tuple]) -> dict[str, tuple[float, float]]:
    """What few and what many forms of each stem are worth.

    candidates has the number of forms in toxic documents, told the numbers of
    documents (toxic with few, clean with few, toxic with many, clean with
    many). Stems that a longer one nearly equals give way to it, and those that
    begin with a shorter one that is left are dropped.
    """
    near = {s[:-1] for s in told if s[:-1] in told and candidates[s] >= NEARLY_ALL * candidates[s[:-1]]}
    kept: dict[str, tuple[float, float]] = {}
    for stem in sorted(set(told) - near, key=lambda s: (len(s), s)):
        if not any(stem[:n] in kept for n in STEM_LETTERS if n < len(stem)):
            few_bad, few_good, more_bad, more_good = told[stem]
            one = worth(few_bad, few_good)
            kept[stem] = one, max(one, worth(more_bad, more_good))
    return kept


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon of sample(doc_id, text, toxic), a written table of bounded size.

    A term is a word, or the first letters that several words share. It is
    counted once for each form of it in each document, on the executors; a term
    is taken if its count in toxic documents is too large for chance and clean
    ones have few of them. Only terms that reach the least count that could
    pass are collected: at most the words of the sample's toxic documents over
    that count. A second pass counts the clean documents that hold a word one
    edit from a term: terms whose variants are ordinary words are matched
    exactly. Words that a stem covers stay for the sake of their variants.
    """
    sizes = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon()
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    letters = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    in_doc = F.array_distinct(F.filter(letters, lambda w: F.length(w) >= LEAST_LETTERS))
    words = written(sample.select("doc_id", "toxic", in_doc.alias("words")).select("doc_id", "toxic", F.size("words").alias("size"), F.explode("words").alias("word")), "toxicity-words")
    bad, good = F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")
    counted = written(words.groupBy("word").agg(bad, good), "toxicity-counts")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("words")).first()
    if not total["bad"] or not total["good"]:
        return Lexicon()
    part = total["bad"] / (total["bad"] + total["good"])
    limit = math.log(MOST_CHANCE / total["words"])
    least = max(LEAST_DOCS, math.ceil(limit / math.log(part)))
    unlikely = lambda r: log_chance(r["bad"], r["bad"] + r["good"], part) <= limit
    share = lambda b, g, bads, goods: (F.col(b) / bads) / (F.col(b) / bads + F.col(g) / goods)
    whole = {r["word"]: worth(r["bad"], r["good"]) for r in counted.filter((F.col("bad") >= least) & (share("bad", "good", toxic, clean) >= LEAST_SHARE)).collect() if unlikely(r)}
    forms = _heads(counted).groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("forms"))
    likely = forms.filter((F.col("bad") >= least) & (F.col("forms") >= LEAST_FORMS) & (share("bad", "good", total["bad"], total["good"]) >= STEM_SHARE))
    candidates = {r["stem"]: r["bad"] for r in likely.collect() if unlikely(r)}
    told = {}
    if candidates:
        asked = sample.sparkSession.createDataFrame([(s,) for s in sorted(candidates)], "stem string")
        by_doc = _heads(words).join(F.broadcast(asked), "stem").groupBy("stem", "doc_id", "toxic", "size").count()
        many = (F.col("count") > 1) & (F.col("count") >= DENSE * F.col("size"))
        kinds = {"few_bad": F.col("toxic") & ~many, "few_good": ~F.col("toxic") & ~many, "more_bad": F.col("toxic") & many, "more_good": ~F.col("toxic") & many}
        by_stem = by_doc.groupBy("stem").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
        passing = by_stem.filter((F.col("more_bad") >= LEAST_DOCS) & (share("more_bad", "more_good", toxic, clean) >= STEM_SHARE))
        told = {r["stem"]: tuple(r[k] for k in kinds) for r in passing.collect()}
    stems = stems_of(candidates, told)
    head = {w: next((w[:n] for n in STEM_LETTERS if n < len(w) and w[:n] in stems), None) for w in whole}
    rows = sorted([(s, True, one, False, more, s) for s, (one, more) in stems.items()] + [(w, False, v, len(w) >= FUZZY_LETTERS, v, head[w]) for w, v in whole.items() if w not in stems])
    place = {r[0]: i for i, r in enumerate(rows)}
    terms, more, of = [r[:4] for r in rows], [r[4] for r in rows], [place[r[5]] if r[5] else i for i, r in enumerate(rows)]
    trial = Lexicon(terms, more, of)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = Scanner(trial), defaultdict(int)
        for batch in batches:
            for text in batch.column("text"):
                for term in {t for t, edits, _, _ in scanner.hits(text.as_py()) if edits}:
                    seen[term] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    innocent = {r["term"]: r["n"] for r in sample.filter("not toxic").select("text").mapInArrow(variants, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return Lexicon([(t, s, w, f and innocent.get(i, 0) <= max(1, INNOCENT * clean)) for i, (t, s, w, f) in enumerate(terms)], more, of)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least of a text's hashed shingles under MINIMA orders; a text of fewer words is one shingle."""
    turns = mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weights = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        out = []
        for first, end, raw, offsets in text_steps(batch.column("text")):
            starts, ends, of = word_bounds(raw, offsets)
            h = word_hashes(raw, starts, ends)
            for a, b in zip(of[:-1], of[1:], strict=True):
                w = h[a:b]
                n = max(len(w) - SHINGLE + 1, 1)
                k = mix64(sum(w[i : i + n] * weights[i] for i in range(min(SHINGLE, len(w))))) if len(w) else w
                out.append([int(mix64(k ^ t).min().view(np.int64)) for t in turns] if len(k) else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "minima"])


def without_copies(rows: list) -> list[int]:
    """Ids, in order, of rows(doc_id, minima) that are no copy of an earlier one that stays: fewer than COPY_SHARE of their minima are the same."""
    buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
    kept, minima = [], np.zeros((len(rows), MINIMA), np.int64)
    for doc_id, own in sorted(rows):
        if own:
            keys = list(enumerate(own[:FIRST]))
            near = np.unique(np.array([j for k in keys for j in buckets.get(k, ())], np.int64))
            if len(near) and ((minima[near] == np.array(own, np.int64)).mean(1) >= COPY_SHARE).any():
                continue
            for k in keys:
                buckets[k].append(len(kept))
            minima[len(kept)] = own
        kept.append(doc_id)
    return sorted(set(kept))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most sample labelled documents that aren't held out, one of each group of near copies.

    Copies would make each of their words look like evidence of its own. Labels
    that are listed more than once count once, a document with both labels is
    toxic; of a doc_id's listings in docs the least text stands for it.
    """
    rows = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    first = rows.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = written(found, "toxicity-sample")
    singles = without_copies(texts.select("doc_id", "text").mapInArrow(_minima, "doc_id long, minima array<long>").collect())
    return texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in singles], "doc_id long")), "doc_id", "left_semi")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Null, empty and wordless texts have no hits and so score 0. Without labels
    of both kinds the lexicon is empty and all scores are 0. A null doc_id isn't
    held out. Repeated rows get equal scores; other columns are ignored. Texts
    are scanned whole, one at a time.
    """
    lexicon = learn(labelled_sample(docs, labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            found = [scanner.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns in order, that score below THRESHOLD.

    The scan hands rows through, so no join moves texts.
    """
    lexicon = learn(labelled_sample(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            fine = [scanner.score(t.as_py()) < THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
