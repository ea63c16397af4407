"""Exact byte-pair encoding as a forward pass over prefixes.

Greedy merging has the property that the encoding of a prefix, less its last
token, is the encoding of a shorter prefix, and that a row of tokens is an
encoding exactly when each two neighbours stay apart, that is when they are
the encoding of their own two texts joined.  So the last token of every prefix
follows from the last tokens of shorter ones: of the vocabulary's tokens that
end there, the one that stays apart from the last token before it.  One pass
gives the token count at every prefix, and words with a common prefix share
the pass up to its end.
"""

from __future__ import annotations

from collections.abc import Callable, Container

#: Joined to the last character of a word in vocabularies that mark word ends.
END = ""
MEMO = 2_000_000  # neighbour pairs remembered; the table is begun anew when full


class Forward:
    def __init__(self, pieces: Container[str], every_piece: list[str], rank: Callable[[str, str], float | None]) -> None:
        self.pieces, self.rank = pieces, rank
        #: for each piece the tokens met before it, and whether the two stay apart
        self.after: dict[str, dict[str, bool]] = {p: {} for p in every_piece if len(p) > 1}
        self.known = 0
        self.reach: dict[str, int] = {}  # the longest piece that ends in these three characters
        sizes: dict[str, set[int]] = {}
        for p in every_piece:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        #: lengths over 1, longest first, of the pieces that end in these three characters
        self.sizes: dict[str, tuple[int, ...]] = {}
        for end, found in sizes.items():
            self.reach[end] = max(found)
            self.sizes[end] = (*sorted(found, reverse=True), *((2,) if end[1:] in self.after else ()))

    @staticmethod
    def symbols(text: str) -> list[str]:
        if text.endswith(END):
            return [*text[:-2], text[-2:]]
        return list(text)

    def merged(self, symbols: list[str]) -> list[str]:
        """Greedy merging itself: the best-ranked pair first, leftmost of equals."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.rank(symbols[i], symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their joined text."""
        rank = self.rank
        # a merge across the border needs a pair of an end of one and a beginning of the other
        out = not any(rank(left[i:], right[:j]) is not None
                      for i in range(len(left)) for j in range(1, len(right) + 1))
        if not out:
            out = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        if self.known >= MEMO:
            for known in self.after.values():
                known.clear()
            self.known = 0
        self.known += 1
        self.after[right][left] = out
        return out

    def fill(self, text: str, starts: list[int], done: int) -> None:
        """``starts[i]``: where the last token of ``text[:i]`` begins, for the
        prefixes longer than ``done``, given those up to it."""
        after, sizes, size = self.after, self.sizes.get, len(text)
        two = (2,)  # no longer piece ends here
        marked = text.endswith(END)
        for i in range(done + 1, size + 1):
            least = 1
            if marked and i >= size - 1:
                if i < size:
                    continue  # the last character has no token without the word's end
                least = 2
            at = i - least  # a single symbol, in the vocabulary or not
            for n in sizes(text[i - 3:i], two) if i > 2 else two:
                j = i - n
                if j < 0:
                    continue
                if n <= least:
                    break
                token = text[j:i]
                known = after.get(token)
                if known is not None:
                    if not j:
                        at = 0
                        break
                    left = text[starts[j]:j]
                    ok = known.get(left)
                    if ok if ok is not None else self.apart(left, token):
                        at = j
                        break
            starts[i] = at

    def starts(self, text: str) -> list[int]:
        """For every prefix length of ``text`` where its last token begins."""
        out = [0] * (len(text) + 1)
        self.fill(text, out, 0)
        return out

    def counts(self, text: str) -> list[int]:
        """Number of tokens of every prefix of ``text``."""
        starts, out = self.starts(text), [0] * (len(text) + 1)
        for i in range(1, len(out)):
            out[i] = out[starts[i]] + 1
        return out

    def tokens(self, text: str, starts: list[int] | None = None) -> list[str]:
        starts = starts or self.starts(text)
        out, i = [], len(text)
        while i:
            out.append(text[starts[i]:i])
            i = starts[i]
        return out[::-1]
