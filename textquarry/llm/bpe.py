"""Byte-pair vocabularies compiled to finite-state transducers.

States are the vocabulary's tokens, a transition reads one further token's bytes
and emits it. A token may follow another only if byte-pair merging of the two
side by side leaves the seam between them alone, and a sequence of tokens is the
encoding of its bytes exactly if this holds for all neighbours; so of all paths
that spell a pretoken just one is allowed, and each prefix has one path at most.
The longest allowed token is tried first; a position from which no path goes on
is left for good, which keeps the work linear in the length.
"""

from __future__ import annotations

import json

NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Exact byte-pair encoding of single pretokens, from the text of a tokenizers .json file with a byte-level BPE model."""

    def __init__(self, spec: str, most_pairs: int = 300_000):
        model = json.loads(spec)["model"]
        symbols, self.end = byte_symbols(), model.get("end_of_word_suffix") or ""
        vocab, self.most_pairs = model["vocab"], most_pairs
        self.size = max(vocab.values()) + 1
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] * self.size + vocab[b], (rank, vocab[a + b]))
        self.bodies: dict[int, tuple[bytes, bool]] = {}
        for token, i in vocab.items():
            closed = bool(self.end) and token.endswith(self.end)
            own = token[: -len(self.end)] if closed else token
            if own and all(c in symbols for c in own):
                self.bodies[i] = bytes(symbols[c] for c in own), closed
        self.single = {body: i for i, body in self.bodies.items() if len(body[0]) == 1}
        self.spines: dict[int, tuple] = {}
        self.edges: dict[int, int] = {}  # a trie of the tokens' bytes: state << 8 | byte
        self.open: dict[int, int] = {}
        self.closed: dict[int, int] = {}
        states = 1
        for i, (body, closed) in self.bodies.items():
            if not self._spine(i):
                continue  # merging its bytes gives other tokens, so no text does
            state = 0
            for byte in body:
                to = self.edges.setdefault(state << 8 | byte, states)
                states += to == states
                state = to
            (self.closed if closed else self.open)[state] = i
        self.follows: dict[int, bool] = {}

    def _spine(self, i: int) -> tuple:
        """The growing pieces, with the ranks that formed them, at token i's left and right edge; empty if its bytes merge to something else."""
        if (got := self.spines.get(i)) is None:
            body, closed = self.bodies[i]
            parts = []
            for k, byte in enumerate(body):
                piece = [(self.single[bytes([byte]), closed and k == len(body) - 1], -1)]
                parts.append((piece[0][0], piece, piece))
            while len(parts) > 1:
                best = min(((*self.ranks[k], p) for p in range(len(parts) - 1) if (k := parts[p][0] * self.size + parts[p + 1][0]) in self.ranks), default=None)
                if best is None:
                    break
                rank, to, p = best
                parts[p : p + 2] = [(to, parts[p][1] + [(to, rank)], parts[p + 1][2] + [(to, rank)])]
            got = self.spines[i] = parts[0][1:] if len(parts) == 1 and parts[0][0] == i else ()
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging a's and b's bytes side by side keeps the seam between them."""
        key = a * self.size + b
        if (got := self.follows.get(key)) is not None:
            return got
        right, left, ranks = self.spines[a][1], self.spines[b][0], self.ranks
        i = j = 0
        while True:
            at_right = right[i + 1][1] if i + 1 < len(right) else NEVER
            at_left = left[j + 1][1] if j + 1 < len(left) else NEVER
            merge = ranks.get(right[i][0] * self.size + left[j][0])
            if merge and merge[0] < at_right and merge[0] <= at_left:
                ok = False
                break
            if at_right == at_left == NEVER:
                ok = True
                break
            if at_right <= at_left:
                i += 1
            else:
                j += 1
        if len(self.follows) >= self.most_pairs:
            self.follows.clear()
        self.follows[key] = ok
        return ok

    def _matches(self, body: bytes, at: int) -> list[tuple[int, int]]:
        """Tokens that begin at a position, with the positions after them, shortest first; a word's last byte belongs to a closing token."""
        edges, out, state, n = self.edges, [], 0, len(body)
        for k in range(at, n):
            if (state := edges.get(state << 8 | body[k])) is None:
                break
            if (i := (self.closed if self.end and k == n - 1 else self.open).get(state)) is not None:
                out.append((i, k + 1))
        return out

    def encode(self, body: bytes) -> list[int]:
        """Token ids of one pretoken."""
        n, at, last = len(body), 0, -1
        taken, left, dead = [], [], set()
        options = self._matches(body, 0) if n else []
        while at < n:
            while options:
                i, to = options.pop()
                if to not in dead and (last < 0 or self.may_follow(last, i)):
                    break
            else:
                if not taken:
                    raise ValueError("the vocabulary lacks tokens for some bytes")
                dead.add(at)
                taken.pop()
                options, at = left.pop()
                last = taken[-1] if taken else -1
                continue
            left.append((options, at))
            taken.append(i)
            at, last = to, i
            if at < n:
                options = self._matches(body, at)
        return taken

    def tokens(self, body: bytes) -> int:
        """Number of tokens of one pretoken: one is emitted on each transition."""
        return len(self.encode(body))


class Kept(dict):
    """A dictionary that computes what it lacks; it starts afresh beyond a bound, which limits memory and changes no result."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value
