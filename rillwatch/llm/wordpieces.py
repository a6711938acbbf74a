"""Token counts: greedy word pieces counted by an automaton, without building pieces.

The vocabulary is a trie with failure links. Where no child fits, a state pops as many tokens as its
precomputed count says and goes on at its failure link, so a word of n bytes takes O(n) steps however
its pieces overlap. The automaton runs on all new words of a step together; each distinct word is
counted once per task.

Words are runs of characters other than white space (space and \\t \\n \\v \\f \\r). A word starts with a
piece and goes on with pieces marked as inner; if it cannot be covered greedily it is one unknown token.

Defined cases: null or empty text has no words and no tokens; rows are counted one by one, also when
they repeat or lack a doc_id.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, steps, table
from .encoders import WordMemo
from .pieces import MARK, model_file, read_model

INNER = "##"
_UNKNOWN = 1 << 40  # in a word's count: how many of its tokens are unknown, in the upper bits


class CountingAutomaton:
    """States of the trie of starting pieces (root 0) and of inner pieces (root 1)."""

    def __init__(self, starting: Iterable[bytes], inner: Iterable[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, words in ((0, starting), (1, inner)):
            for word in words:
                state = root
                for byte in word:
                    following = children[state].get(byte)
                    if following is None:
                        following = len(children)
                        children[state][byte] = following
                        children.append({})
                        final.append(False)
                    state = following
                final[state] = state > 1
        fail = np.full(len(children), -1, np.int32)
        pops = np.zeros(len(children), np.int32)
        level = [0, 1]
        while level:
            deeper = []
            for parent in level:
                for byte, state in children[parent].items():
                    deeper.append(state)
                    if final[state]:
                        fail[state], pops[state] = 1, 1
                        continue
                    link, popped = int(fail[parent]), int(pops[parent])
                    while link >= 0 and byte not in children[link]:
                        popped += int(pops[link])
                        link = int(fail[link])
                    if link >= 0:
                        fail[state], pops[state] = children[link][byte], popped
            level = deeper
        edges = [(s << 8 | b, c) for s, some in enumerate(children) for b, c in some.items()]
        edges.sort()
        self.keys = np.array([e[0] for e in edges], np.int64)
        self.targets = np.array([e[1] for e in edges], np.int32)
        self.fail, self.pops = fail, pops

    def _child(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        wanted = states.astype(np.int64) << 8 | codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1) if len(self.keys) else wanted * 0 - 1

    def count(self, words: list[bytes]) -> list[int]:
        """Tokens of each word; an unknown word is one token, marked in the upper bits."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(len(words), np.int32)
        tokens = np.zeros(len(words), np.int64)
        on = np.arange(len(words))
        for place in range(int(sizes.max(initial=0))):
            on = on[(sizes[on] > place) & (state[on] >= 0)]
            waiting = on
            while len(waiting):
                found = self._child(state[waiting], data[starts[waiting] + place])
                hit = found >= 0
                state[waiting[hit]] = found[hit]
                waiting = waiting[~hit]
                tokens[waiting] += self.pops[state[waiting]]
                state[waiting] = self.fail[state[waiting]]
                waiting = waiting[state[waiting] >= 0]
        # what is left of each word pops until only the root of inner pieces remains
        on = np.flatnonzero((state >= 0) & (state != 1))
        while len(on):
            tokens[on] += self.pops[state[on]]
            state[on] = self.fail[state[on]]
            on = on[(state[on] >= 0) & (state[on] != 1)]
        tokens[state < 0] = 1 | _UNKNOWN
        return tokens.tolist()


def word_piece_vocabulary(model_path: str) -> tuple[list[bytes], list[bytes]]:
    """Starting and inner pieces out of a piece model: those with and without the mark."""
    model = read_model(model_path)
    plain = [p for p, ordinary in zip(model["pieces"], model["ordinary"]) if ordinary]
    starting = [p.removeprefix(MARK).encode() for p in plain if p.startswith(MARK)]
    return [p for p in starting if p and MARK.encode() not in p], [
        p.encode() for p in plain if MARK not in p
    ]


def word_piece_counts(docs: DataFrame, starting: list[bytes], inner: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each text."""
    shared_words = docs.sparkSession.sparkContext.broadcast({"starting": starting, "inner": inner})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = shared_words.value
        if "memo" not in shared:
            shared["memo"] = WordMemo(CountingAutomaton(shared["starting"], shared["inner"]).count)
        memo = shared["memo"]
        for batch in steps(batches):
            cut = [text.split() for text in byte_texts(batch.column("text"))]
            memo.trim()
            memo.learn(w for words in cut for w in words)
            sums = np.array([sum(map(memo.__getitem__, words)) for words in cut], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(words) for words in cut], pa.int64()),
                    pa.array(sums % _UNKNOWN),
                    pa.array(sums // _UNKNOWN),
                ],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    starting, inner = word_piece_vocabulary(model_file(model_path))
    return word_piece_counts(table(spark, sf_dir, "documents"), starting, inner)
