"""License scans, spelling variants and resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import clashing, documents, edge_texts, mixed_texts

from rillwatch.llm import licenses, resampling, spelling
from rillwatch.llm.common import table, word_chunks
from rillwatch.llm.licenses import BASE, TEMPLATES, Template


def _ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _ascii_lower(text or ""))


# ---------------------------------------------------------------- license scans


def plain_ends(parts, words, at):
    """All places behind a match of the parts that begins at ``at``, by trying every way."""
    if not parts:
        return {at}
    first, rest = parts[0], parts[1:]
    if isinstance(first, bytes):
        fits = at < len(words) and words[at].encode() == first
        return plain_ends(rest, words, at + 1) if fits else set()
    if first[0] == "any":
        starts = {at + n for n in range(first[1], first[2] + 1) if at + n <= len(words)}
    else:
        ways = [first[1], ()] if first[0] == "optional" else first[1]
        starts = set().union(*(plain_ends(way, words, at) for way in ways))
    return set().union(*(plain_ends(rest, words, s) for s in starts)) if starts else set()


def plain_matches(text, templates):
    words = _words(text)
    out = []
    for at in range(len(words)):
        for template in templates:
            ends = plain_ends(licenses.parse_markup(template.markup), words, at)
            if ends:
                out.append((template.label, template.base, at, max(ends)))
    return len(words), sorted(out)


def _check_scan(df, templates):
    rows = df.select("doc_id", "text").collect()
    got = [
        (r.doc_id, r.n_words, sorted((m.label, m.base, m.start, m.end) for m in r.matches))
        for r in licenses.license_matches(df, templates).collect()
    ]
    wanted = [(r.doc_id, *plain_matches(r.text, templates)) for r in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    return got


ODD = (
    Template("one", "alpha beta <<optional>>gamma<<end>> delta"),
    Template("two", "alpha beta <<any 0 2>> delta"),
    Template("three", "beta gamma <<either>>alpha<<or>>delta <<optional>>alpha beta<<end>><<end>> gamma"),
    Template("four", "alpha alpha <<any 1 3>> <<optional>>alpha<<end>> alpha"),
    Template("base", "beta beta", True),
)


def test_scan_of_random_words(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["Alpha", "beta", "gamma", "delta", "x"], k=rnd.randint(0, 40))) for _ in range(150)]
    got = _check_scan(documents(spark, texts).repartition(3), ODD)
    assert {m[0] for r in got for m in r[2]} == {t.label for t in ODD}


def _filled(parts, rnd):
    """Some text that a template accepts."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            out.append(part.decode())
        elif part[0] == "any":
            out += [f"name{i}" for i in range(rnd.randint(part[1], part[2]))]
        elif part[0] == "optional":
            out += _filled(part[1], rnd) if rnd.random() < 0.5 else []
        else:
            out += _filled(rnd.choice(part[1]), rnd)
    return out


def test_scan_accepts_every_template_and_nothing_less(spark):
    rnd = random.Random(8)
    texts, wanted = [], []
    for template in BASE + TEMPLATES:
        words = _filled(licenses.parse_markup(template.markup), rnd)
        texts.append("Some words, then:\n" + ", ".join(words).upper() + ". And more.")
        wanted.append(template.label)
        # without its second word, which is mandatory
        texts.append(" ".join(words[:1] + words[2:]))
        wanted.append(None)
    got = {r[0]: r[2] for r in _check_scan(documents(spark, texts), BASE + TEMPLATES)}
    for number, label in enumerate(wanted):
        labels = {m[0] for m in got[number]}
        assert label in labels if label else len(got[number]) < len(got[number - 1])


def test_scan_of_edge_cases(spark):
    texts = edge_texts() + [(40, "the MIT License" * 3), (41, "mit\tlicense mit license"), (42, "Mit licenseé mit")]
    docs = clashing(documents(spark, texts))
    _check_scan(docs, BASE + TEMPLATES)
    assert licenses.license_matches(docs.limit(0)).count() == 0


def test_scan_of_a_text_of_many_pieces(spark, monkeypatch):
    """Words are cut piece by piece, and a match may lie over the cut."""
    text = ("mit license " * 400).encode()
    whole = licenses.LicenseAutomaton(BASE).word_numbers(text)
    monkeypatch.setattr(licenses, "word_chunks", lambda data, words: word_chunks(data, words, 7))
    assert licenses.LicenseAutomaton(BASE).word_numbers(text) == whole


@pytest.mark.parametrize("markup", ["<<optional>>a<<end>> b", "a", "a <<any 0 2>> b", "a b <<optional>> c", "a b <<what>>"])
def test_bad_templates_are_refused(spark, markup):
    with pytest.raises(ValueError):
        licenses.license_matches(documents(spark, ["a"]), [Template("bad", markup)])


def test_forgetting_states_changes_nothing(monkeypatch):
    rnd = random.Random(2)
    automaton = licenses.LicenseAutomaton(ODD)
    words = np.array(automaton.word_numbers(" ".join(rnd.choices(["alpha", "beta", "gamma"], k=3000)).encode()))
    first = list(automaton.matches(words))
    monkeypatch.setattr(licenses, "MOST_STATES", 0)
    assert list(automaton.matches(words)) == first


# ---------------------------------------------------------------- spelling variants


def plain_counts(found, least_length=7, least_count=2, every=31):
    counts = Counter()
    for doc_id, text in found:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def plain_near(words):
    """Near words of each word, by its deletions."""
    held = {}
    for word in words:
        held.setdefault(word, set()).add(word)
        for i in range(len(word)):
            held.setdefault((i, word[:i] + word[i + 1 :]), set()).add(word)
    near = {w: set() for w in words}
    for word in words:
        for i in range(len(word)):
            rest = word[:i] + word[i + 1 :]
            for other in held[i, rest] - {word}:
                near[word].add(other)
            for other in held.get(rest, ()):
                near[word].add(other)
                near[other].add(word)
    return near


def plain_variants(counts, times=10):
    near = plain_near(counts)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= times * n else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return sorted(out)


def _variants(df, **options):
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **options).collect())


def _spelled(count, seed):
    """Texts of few syllables with many misspelt words, long words among them."""
    rnd = random.Random(seed)
    syllables = ["ta", "lo", "ré", "mi", "ÿs", "no", "éé"]
    stock = ["".join(rnd.choices(syllables, k=rnd.randint(3, 6))) for _ in range(60)]
    stock += ["".join(rnd.choices(syllables, k=40)), "a" * 9, "a" * 60, "ab" * 26]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(rnd.randint(0, 60)):
            word = rnd.choice(stock[: rnd.randint(1, len(stock))])
            if rnd.random() < 0.2:
                at = rnd.randrange(len(word) + 1)
                kind = rnd.random()
                new = rnd.choice("talréÿz")
                word = word[:at] + (new if kind < 0.7 else "") + word[at + (kind > 0.3) :]
            words.append(word.upper() if rnd.random() < 0.1 else word)
        texts.append(rnd.choice([" ", ", ", "\n", "1", "–"]).join(words))
    # a form that has a form itself, and a word with many near ones
    texts += ["talomira " * 300 + "talomirx " * 25 + "talomixx " * 2] * 3
    texts += [" ".join(f"talomir{c} talom{c}ra" for c in "bcdefgh")] * 2
    return texts


@pytest.mark.parametrize("block", [2048, 4])
def test_variants_as_in_plain_python(spark, block):
    texts = _spelled(150, 6)
    wanted = plain_variants(plain_counts(enumerate(texts)))
    assert any(r[1] and r[2] != r[1] for r in wanted) and max(r[4] for r in wanted) > 5
    assert _variants(documents(spark, texts).repartition(3), block=block) == wanted


def test_variants_of_short_and_rare_words(spark):
    texts = _spelled(60, 9) + ["ab abc abd acd bd", "ab abc abd acd bd"]
    counts = plain_counts(enumerate(texts), 4, 1, 5)
    assert _variants(documents(spark, texts), least_length=4, least_count=1, every=5, times=3) == plain_variants(counts, 3)


def test_variants_of_edge_cases(spark):
    texts = edge_texts() + [(50, "Ünïcödé ünïcödé naïvement naïvment naïvement " * 3)]
    docs = clashing(documents(spark, texts))
    found = [(r.doc_id, r.text) for r in docs.collect()]
    assert _variants(docs) == plain_variants(plain_counts(found))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(documents(spark, ["no long words", None])).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rnd = np.random.default_rng(3)
    ranks = rnd.integers(0, 9, (400, 7))
    costs = ranks * 3 + 1
    prefix = spelling.prefix_places(ranks)
    chosen = spelling.pivot_places(costs, prefix)
    for row in range(len(ranks)):
        places = [p for p in range(7) if prefix[row, p]]
        assert len(places) >= 3
        best = min(costs[row, p] + costs[row, q] for p in places for q in places if q >= p + 2)
        first, second = chosen[row]
        assert second >= first + 2 and prefix[row, first] and prefix[row, second]
        assert costs[row, first] + costs[row, second] == best


def test_long_texts_are_cut_between_runs():
    text = "Abcdefgh ÿijklmno, 1 " * 50
    pattern = re.compile(rb"[a-z\xc0-\xff]{7,}")
    whole = [w for some in spelling.letter_runs(text, pattern) for w in some]
    assert [w for some in spelling.letter_runs(text, pattern, 5) for w in some] == whole and len(whole) == 100


# ---------------------------------------------------------------- resampling


def plain_resample(found, target, buckets=10_000, least=20, percent=25, seed=7):
    def features(text):
        words = _words(text)
        return words, [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = Counter(), Counter()
    for _, text in found:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc_id, text in found:
        words, codes = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in codes]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(words), len(codes), weight, weight + noise))
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0]))
    ranks = {}
    for rank, row in enumerate(can[: len(can) * percent // 100], 1):
        ranks.setdefault(row, []).append(rank)
    return sorted(((*r, ranks[r].pop() if ranks.get(r) else None) for r in rows), key=repr)


def _resampled(docs, target, **options):
    found = resampling.resample(docs, target, **options)
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.select(*names).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"pivots": 1, "range_rows": 7}, {"buckets": 50, "percent": 60, "least_words": 1}])
def test_resampling_as_in_plain_python(spark, options):
    texts = mixed_texts(200)
    target = documents(spark, mixed_texts(20, seed=5))
    plain = {"least" if k == "least_words" else k: v for k, v in options.items() if k not in ("pivots", "range_rows")}
    wanted = plain_resample(list(enumerate(texts)), [r.text for r in target.collect()], **plain)
    assert sum(r[5] is not None for r in wanted) > 20
    assert _resampled(documents(spark, texts).repartition(5), target, **options) == wanted


def test_resampling_of_edge_cases(spark):
    docs = clashing(documents(spark, edge_texts() * 3))
    target = clashing(documents(spark, [None, "", "the same text"]))
    found = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = plain_resample(found, [r.text for r in target.collect()], least=1, percent=50)
    got = _resampled(docs, target, least_words=1, percent=50)
    # of rows that are alike any may be drawn
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in wanted if r[5])
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == docs.count()


def test_buckets_are_checksums_of_words_and_pairs():
    rnd = random.Random(1)
    words = [bytes(rnd.choices(b"abz09\xc3\xa9", k=rnd.choice([1, 2, 9, 64, 65, 66, 130, 700]))) for _ in range(300)]
    hasher = resampling.FeatureHasher(2**31, memory=50)
    for _ in range(2):  # the second time after forgetting
        single, pairs, counts = hasher.features([b" ".join(words[:200]), b"", b"-".join(words[200:])])
        assert counts.tolist() == [200, 0, 100]
        assert single.tolist() == [zlib.crc32(w) % 2**31 for w in words]
        joined = [zlib.crc32(a + b" " + b) % 2**31 for a, b in zip(words, words[1:])] + [-1]
        joined[199] = -1
        assert pairs.tolist() == joined


@pytest.mark.parametrize("pivots", [1, 3, 40])
def test_kth_smallest_key(spark, pivots):
    rnd = random.Random(pivots)
    keys = [(rnd.randint(-5, 5), rnd.randint(0, 9), i) for i in range(200)]
    rows = spark.createDataFrame(keys, "a bigint, b bigint, c bigint").repartition(4).cache()
    for k in (1, 2, 57, 199, 200):
        assert resampling.kth_smallest(rows, ["a", "b", "c"], k, pivots) == sorted(keys)[k - 1]
    assert resampling.kth_smallest(rows, ["a", "b", "c"], 201, pivots) is None
    assert resampling.kth_smallest(rows, ["a", "b", "c"], 0, pivots) is None


def test_queries_read_whole_tables(spark, sf_dir):
    ids = sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect())
    for query in (licenses.op11_license_scan, resampling.op13_importance_resampling):
        assert sorted(r.doc_id for r in query(spark, sf_dir).select("doc_id").collect()) == ids
