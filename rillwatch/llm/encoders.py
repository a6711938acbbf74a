"""Dictionary of encoded words, shared by the tokenizing operators."""

from collections.abc import Callable, Iterable
from itertools import islice

# words that a task remembers; beyond them it forgets the older half, so that its memory stays bounded
MEMO_WORDS = 300_000


class WordMemo(dict):
    """Words to their encoded form; unknown words of a text are encoded together."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable], limit: int = MEMO_WORDS):
        super().__init__()
        self.encode = encode
        self.limit = limit

    def trim(self) -> None:
        """Forget the older half once there are too many words; call it before, not within, a text."""
        if len(self) > self.limit:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)

    def learn(self, words: Iterable[bytes]) -> None:
        """Make sure that all of ``words`` are known."""
        new = [w for w in set(words) if w not in self]
        if new:
            self.update(zip(new, self.encode(new)))

    def look_up(self, words: list[bytes]) -> list:
        """The encoded form of each word."""
        found = list(map(self.get, words))
        missing = [i for i, form in enumerate(found) if form is None]
        if missing:
            self.learn([words[i] for i in missing])
            for i in missing:
                found[i] = self[words[i]]
        return found


def joined(parts: list[bytes], counts: Iterable[int]) -> list[bytes]:
    """The first so many parts put together, then the next ones, and so on."""
    out, at = [], 0
    for count in counts:
        out.append(b"".join(parts[at : at + count]))
        at += count
    return out
