"""SentencePiece encoding for merge-type (BPE) vocabularies with a score-ordered agenda.

All adjacent pairs of symbols that spell a piece wait in an agenda ordered by score, then place. The best pair is
merged, its two new neighbours join the agenda, and entries whose symbols have changed meanwhile are passed over.
Characters left without a piece become byte pieces.

A merge can never cross two characters that stand side by side in no piece. Texts are cut at such places and a
worker remembers the ids of the words and stretches it has met, so the agenda runs once for each. In every Arrow batch
the library encodes, whole, every word that the worker has not just looked up (so every id has been checked in its word),
and one whole text, the one with the least hash; a difference ends the job.

Bounds: identity normalisation with a space before the text (ValueError for other models). An empty text has no
ids and decodes to the empty text. Text of any length takes time in proportion to its length and memory for its ids.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import xxhash

BLANK = "▁"
#: Words, and stretches of words, that one worker remembers.
CACHE_WORDS = 1_000_000
#: Up to so many symbols the agenda is a list searched for its least entry, above that a heap.
SHORT = 40
INF = float("inf")

_loaded: dict[str, MergeCodec] = {}


def worker_codec(path: str) -> MergeCodec:
    if path not in _loaded:
        _loaded[path] = MergeCodec(path)
    return _loaded[path]


class MergeCodec:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a\tﬁ  b "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str) != [BLANK + "a"] and sp.encode("a", out_type=str)[0] != BLANK:
            raise ValueError("only models with identity normalisation and a space before the text can be read")
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id() if any(not sp.is_byte(i) for i in self.bytes) else None
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        #: Whether a blank can only begin a word, alone or after other blanks.
        self.blank_begins = not any(a != BLANK and b == BLANK for a, b in self.joined)
        self.limit = cache_words
        self.words: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.fresh: list[tuple[str, tuple[int, ...]]] = []

    def agenda(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which blanks are already BLANK."""
        symbols = list(text)
        if len(symbols) > SHORT:
            self._merge_long(symbols)
        else:
            get = self.cost.get
            agenda = [get(a + b, INF) for a, b in zip(symbols, symbols[1:], strict=False)]
            while agenda and (best := min(agenda)) < INF:
                k = agenda.index(best)
                symbols[k] = piece = symbols[k] + symbols.pop(k + 1)
                del agenda[k]
                if k < len(agenda):
                    agenda[k] = get(piece + symbols[k + 1], INF)
                if k:
                    agenda[k - 1] = get(symbols[k - 1] + piece, INF)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                elif self.unknown is not None:
                    out.append(self.unknown)
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return tuple(out)

    def _merge_long(self, symbols: list[str | None]) -> None:
        """Merges in place, with the agenda as a heap; merged symbols leave None behind."""
        cost, n = self.cost, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []
        for k in range(n - 1):
            piece = symbols[k] + symbols[k + 1]
            if piece in cost:
                waiting.append((cost[piece], k, piece))
        heapify(waiting)
        while waiting:
            _, left, piece = heappop(waiting)
            right = after[left]
            if right >= n or symbols[left] is None or len(symbols[left]) + len(symbols[right]) != len(piece) or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = follow = after[right]
            if follow < n:
                before[follow] = left
                if (longer := piece + symbols[follow]) in cost:
                    heappush(waiting, (cost[longer], left, longer))
            if (prior := before[left]) >= 0 and (longer := symbols[prior] + piece) in cost:
                heappush(waiting, (cost[longer], prior, longer))

    def _word(self, word: str) -> tuple[int, ...]:
        if word[1:].isalpha():
            cuts = [0, len(word)]
        else:
            joined = self.joined
            cuts = [0, *(k for k, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in joined), len(word)]
        out: tuple[int, ...] = ()
        for i, j in zip(cuts, cuts[1:], strict=False):
            stretch = word[i:j]
            ids = self.stretches.get(stretch)
            if ids is None:
                ids = self.agenda(stretch)
                if len(self.stretches) >= self.limit:
                    self.stretches.clear()
                self.stretches[stretch] = ids
            out += ids
        self.fresh.append((word, out))
        if len(self.words) >= self.limit:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = out
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if not self.blank_begins:
            return list(self.agenda(text))
        if BLANK + BLANK in text:
            words, at = [], 0
            for k in range(1, len(text)):
                if text[k] == BLANK and text[k - 1] != BLANK:
                    words.append(text[at:k])
                    at = k
            words.append(text[at:])
        else:
            words = text.split(BLANK)
            del words[0]
            words = list(map(BLANK.__add__, words))
        get, out = self.words.get, []
        for word in words:
            out += get(word) or self._word(word)
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        self.fresh = []
        out = [self.encode(t) for t in texts]
        self._check([w[1:].replace(BLANK, " ") for w, _ in self.fresh], [ids for _, ids in self.fresh])
        k = min(range(len(texts)), key=lambda k: xxhash.xxh3_64_intdigest(texts[k].encode()), default=0)
        self._check(texts[k : k + 1], out[k : k + 1])
        return out

    def _check(self, texts: list[str], ids: list) -> None:
        """A word's ids are those of its text after a space, which the library puts before every text but the empty one."""
        for text, mine, library in zip(texts, ids, self.library.encode(texts, num_threads=1) if texts else (), strict=True):
            if text and list(mine) != library:
                raise ValueError(f"ids differ from the library's: {text[:100]!r}")

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(i) if i else "" for i in ids]
