"""Line dedup, token counts, token files and pieces against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import clashing, documents, edge_texts, mixed_texts

from rillwatch.llm import line_dedup, pieces, token_files, wordpieces
from rillwatch.llm.common import table
from rillwatch.llm.encoders import WordMemo, joined
from rillwatch.llm.trie import ROOT, DoubleArrayTrie

WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


# ---------------------------------------------------------------- line dedup


def _ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_line_dedup(found, least=10):
    """(doc_id, text) rows to (doc_id, lines, dropped, kept text), None sorting first."""
    keys = [[_ascii_lower(x.strip(WHITE)) for x in (t or "").split("\n")] for _, t in found]
    rank = [-1 if i is None else i for i, _ in found]
    holders = {}
    for r, some in zip(rank, keys):
        for key in some:
            holders.setdefault(key, set()).add(r)
    out = []
    for (i, t), r, some in zip(found, rank, keys):
        drop = [len(k) >= least and min(holders[k]) < r for k in some]
        kept = [x for x, d in zip((t or "").split("\n"), drop) if not d]
        out.append((i, len(some), sum(drop), "\n".join(kept)))
    return out


def _check_lines(df):
    found = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    kept = line_dedup.apply_keep_bitmaps(df, line_dedup.line_keep_bitmaps(df))
    got = [(r.row.doc_id, r.kept.n_lines, r.kept.n_dropped, r.kept.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(plain_line_dedup(found), key=repr)


@pytest.mark.parametrize("texts", [edge_texts(), mixed_texts(), []], ids=["edges", "mixed", "empty"])
def test_lines_as_in_plain_python(spark, texts):
    _check_lines(documents(spark, texts))


def test_line_held_by_most_documents(spark):
    _check_lines(documents(spark, [f"own line number {i}\nthe line of everyone\nshort" for i in range(3000)]).repartition(7))


def test_lines_with_other_columns(spark):
    docs = clashing(documents(spark, mixed_texts(30)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    for row in out.collect():
        assert row.n_chars == len(row.text) and row.words == "x"


def test_bitmap_is_compressed_flags():
    bitmap = line_dedup.keep_bitmap([3, 70])
    flags = line_dedup.kept_flags(bitmap, 200)
    assert [i for i, f in enumerate(flags) if not f] == [3, 70]
    assert line_dedup.kept_flags(None, 3).all()


# ---------------------------------------------------------------- token counts


def plain_word_pieces(word, starting, inner):
    at, count, pool = 0, 0, starting
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pool:
                at, count, pool = end, count + 1, inner
                break
        else:
            return None
    return count


def test_automaton_counts_like_greedy_matching():
    rnd = random.Random(5)
    for _ in range(60):
        pick = lambda: bytes(rnd.choices(b"abc", k=rnd.randint(1, 5)))
        starting, inner = {pick() for _ in range(8)}, {pick() for _ in range(8)}
        automaton = wordpieces.CountingAutomaton(sorted(starting), sorted(inner))
        words = sorted({bytes(rnd.choices(b"abcd", k=rnd.randint(1, 9))) for _ in range(80)})
        for word, got in zip(words, automaton.count(words)):
            wanted = plain_word_pieces(word, starting, inner)
            assert got == (1 | wordpieces._UNKNOWN if wanted is None else wanted), word


def test_token_counts_on_documents(spark, public):
    starting, inner = wordpieces.word_piece_vocabulary(public.path("piece_bpe_32k.model"))
    docs = clashing(documents(spark, edge_texts() + [(50, mixed_texts(5)[0])]))
    first, other = set(starting), set(inner)
    wanted = []
    for row in docs.select("doc_id", "text").collect():
        counts = [plain_word_pieces(w, first, other) for w in (row.text or "").encode().split()]
        wanted.append((row.doc_id, len(counts), sum(c or 1 for c in counts), counts.count(None)))
    got = [tuple(r) for r in wordpieces.word_piece_counts(docs, starting, inner).collect()]
    assert Counter(got) == Counter(wanted)
    assert wordpieces.word_piece_counts(docs.limit(0), starting, inner).count() == 0


def test_query_token_counts(spark, sf_dir, public):
    starting, inner = map(set, wordpieces.word_piece_vocabulary(public.path("piece_bpe_32k.model")))
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for row in wordpieces.op3_token_counts(spark, sf_dir).collect():
        counts = [plain_word_pieces(w, starting, inner) for w in (texts.pop(row.doc_id) or "").encode().split()]
        assert (row.n_words, row.n_unknown) == (len(counts), counts.count(None))
        assert row.n_tokens == sum(c or 1 for c in counts)
    assert not texts


# ---------------------------------------------------------------- token files


def test_elias_fano_holds_any_ends():
    rnd = random.Random(1)
    for size in (1, 2, 63, 64, 65, 500):
        for most in (0, 1, 3, 1000, 10**6):
            values = np.cumsum([rnd.randint(0, most) for _ in range(size)])
            coded = token_files.EliasFano.build(values)
            assert (coded.values() == values).all()
            assert [coded.select(i) for i in range(size)] == values.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    coded = token_files.EliasFano.build(ends)
    assert (len(coded.low) + len(coded.upper)) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 0.5


def plain_token_files(found, tokenizer):
    start, out = 0, []
    for doc_id, text in found:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def _tokenizer(public, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(name))


def test_query_token_files(spark, sf_dir, public):
    texts = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = sorted(tuple(r) for r in token_files.op6_token_files(spark, sf_dir).collect())
    assert got == plain_token_files(texts, _tokenizer(public))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_of_odd_texts(spark, public, name):
    odd = [
        "<|endoftext|> inside <|startoftext|>", "don't we're I'LL it's", "ÉCOLE École é é ß İstanbul",
        "a.b,c!! $$$ 12345 x²", "tab\tand nbsp wide", "ﬁne Å Ω ςΣ", "UPPER,lower|bar", None, "", "'s", "a's.",
    ]
    texts = list(enumerate(odd * 3))
    docs = clashing(documents(spark, texts)).repartition(5)
    segments = token_files.token_segments(docs, public.path(name), segment_ids=50)
    got = sorted(tuple(r) for r in token_files.segment_documents(segments).collect())
    assert got == plain_token_files(texts, _tokenizer(public, name))
    row = segments.orderBy("part", "seq").first()
    segment = token_files.Segment(bytes(row.payload))
    whole = np.concatenate([segment.document(i) for i in range(segment.n_docs)])
    assert (whole == segment.ids).all() and segment.n_docs == len(row.doc_ids)


def test_word_by_word_needs_a_tokenizer_that_allows_it(spark, public):
    docs = documents(spark, ["a b"])
    with pytest.raises(ValueError, match="apart"):
        token_files.token_segments(docs, public.path("byte_bpe_50k.json"), by_word=True)


def test_forgetting_words_changes_no_ids(spark, public, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 3)
    texts = [t.encode() for t in mixed_texts(40)] + [b"a, b. c", b""]
    definition = open(public.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder = token_files.TextEncoder(definition, 2, True)
    for at in range(0, len(texts), 4):
        some = texts[at : at + 4]
        assert encoder.encode(some) == [encoder.whole(t) for t in some]


def test_memory_forgets_its_older_half():
    memo = WordMemo(lambda words: [w.upper() for w in words], limit=4)
    assert memo.look_up([b"a", b"b", b"a", b"c", b"d", b"e", b"f"]) == [b"A", b"B", b"A", b"C", b"D", b"E", b"F"]
    older = list(memo)[:3]
    memo.trim()
    assert len(memo) == 3 and not set(older) & set(memo)
    assert joined(memo.look_up([b"a", b"f", b"b"]), [2, 0, 1]) == [b"AF", b"", b"B"]


def test_token_files_of_edge_cases(spark, public):
    path = public.path("word_bpe_49k.json")
    docs = documents(spark, edge_texts())
    got = token_files.segment_documents(token_files.token_segments(docs, path)).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == len(edge_texts())
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert token_files.segment_documents(token_files.token_segments(docs.limit(0), path)).count() == 0


# ---------------------------------------------------------------- pieces


def test_trie_finds_exactly_its_words():
    rnd = random.Random(9)
    words = {bytes(rnd.choices(range(256), k=rnd.randint(1, 6))): i for i in range(800) for _ in (0,)}
    trie = DoubleArrayTrie.build(words)
    for word in list(words) + [bytes(rnd.choices(range(256), k=3)) for _ in range(500)]:
        state = np.array([ROOT])
        for byte in word:
            state = trie.step(state, np.array([byte])) if state[0] else state
        assert (int(trie.value[state[0]]) if state[0] else -1) == words.get(word, -1)


def plain_best_score(word, scores, unknown):
    """Score of the best split of a word (characters), unknown characters included."""
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            part = word[start:end]
            score = scores.get(part, unknown if end - start == 1 else None)
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_pieces_are_the_best_split(public):
    model = pieces.read_model(public.path("piece_bpe_32k.model"))
    coder = pieces.PieceModel(**model)
    scores = {p: s for p, s, o in zip(model["pieces"], model["scores"], model["ordinary"]) if o}
    words = [" the", " tionhendouin", " 漢字", " Ünïcödé", "  two", " qqzzxxw.", " a\t", " 12,345.67", " éçà", "\n"]
    for word, raw in zip(words, coder.split_words([w.encode() for w in words])):
        ids = np.frombuffer(raw, coder.kind).tolist()
        total, at, data = 0.0, 0, word.encode()
        while at < len(ids):
            if model["ordinary"][ids[at]]:
                total, at = total + model["scores"][ids[at]], at + 1
            else:  # bytes of one character without a piece
                lead = int(model["pieces"][ids[at]][3:5], 16)
                total, at = total + coder.unknown, at + 1 + sum(lead >= x for x in (0xC0, 0xE0, 0xF0))
        assert b"".join(coder.table[i] for i in ids) == data
        assert total == pytest.approx(plain_best_score(word.replace(" ", pieces.MARK), scores, coder.unknown))


def test_pieces_read_back(spark, public):
    path = public.path("piece_bpe_32k.model")
    texts = edge_texts() + [(60, "  lead\n\n and trail  "), (61, "a▁b"), (62, "tab\tand nbsp \x00 end")]
    docs = clashing(documents(spark, texts))
    out = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    for row in out.select("text", "ids", "decoded").collect():
        assert row.decoded == (None if row.text is None else row.text.replace(pieces.MARK, " "))
        assert (row.ids is None) == (row.text is None)
    assert pieces.piece_round_trip(docs.limit(0), path).count() == 0


def test_query_sentencepiece(spark, sf_dir, public):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    coder = pieces.PieceModel(**pieces.read_model(public.path("piece_bpe_32k.model")))
    for row in pieces.op9_sentencepiece(spark, sf_dir).collect():
        text = texts.pop(row.doc_id)
        assert row.round_trip and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.n_tokens == len(coder.encode([text.encode()])[0]) // coder.width
    assert not texts


def test_each_text_is_encoded_once(spark, public, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    encode = pieces.PieceModel.encode

    def counted(self, texts):
        with open(log, "a") as file:
            file.write(f"{len(texts)}\n")
        return encode(self, texts)

    monkeypatch.setattr(pieces.PieceModel, "encode", counted)
    docs = documents(spark, mixed_texts(200)).repartition(3)
    pieces.piece_round_trip(docs, public.path("piece_bpe_32k.model")).collect()
    assert sum(map(int, open(log).read().split())) == 200


def test_pieces_of_a_long_text_without_a_space(spark, public):
    path = public.path("piece_bpe_32k.model")
    row = pieces.pieces_and_back(documents(spark, ["ab漢" * 30_000]), path).first()
    assert row.decoded == "ab漢" * 30_000 and row.lang == "en"


def test_all_words_of_a_table_are_split_best(spark, sf_dir, public):
    """Every tenth distinct word of all texts against a plain search over all splits."""
    model = pieces.read_model(public.path("piece_bpe_32k.model"))
    coder = pieces.PieceModel(**model)
    scores = {p: s for p, s, o in zip(model["pieces"], model["scores"], model["ordinary"]) if o}
    words = sorted({w for r in table(spark, sf_dir, "documents").collect() for w in r.text.split()})[::10]
    for word, raw in zip(words, coder.split_words([f" {w}".encode() for w in words])):
        ids = np.frombuffer(raw, coder.kind).tolist()
        if all(model["ordinary"][i] for i in ids):
            total = sum(model["scores"][i] for i in ids)
            assert total == pytest.approx(plain_best_score(pieces.MARK + word, scores, coder.unknown)), word


def test_scores_of_a_model_are_used_as_they_are(public):
    path = public.path("piece_bpe_32k.model")
    given, ranked = (pieces.read_model(path, merge_ranks=x)["scores"] for x in (False, True))
    assert given.min() < -1000 and ranked.min() > -25


def test_decoding_mends_broken_bytes(spark, public):
    path = public.path("piece_bpe_32k.model")
    byte_ids = pieces.read_model(path)["byte_ids"]
    rows = spark.createDataFrame([([int(byte_ids[0xC3])],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(rows, path).collect()] == ["�", None, ""]
