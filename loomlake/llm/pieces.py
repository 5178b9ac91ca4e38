"""SentencePiece encoding and decoding: n-best segmentation by A* from the end, guided by forward Viterbi."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship
from .common import hold, table, touch, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
#: Words kept with their segmentation, in each of two generations of a Python worker; longer ones aren't kept.
#: A word and what is kept of it take under 800 bytes, mostly under 400: some 115 MB.
CACHE, CACHE_CHARS = 150_000, 64
#: So many words of one length are segmented side by side: their arcs, 8 bytes each, are kept until all scores are known.
SIDE = 4096
#: Texts of so many characters are segmented together.
BODIES = 1 << 21
#: Words kept with their n best segmentations, in each of two generations: words with the least gap of a text come again
#: and again. With three segmentations of up to 64 characters a word takes under 2 KB, mostly under 700 bytes.
RANKED = 5_000


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: normal, byte, control or unknown."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class Pieces:
    """A lattice over the characters of a text: an arc for each piece, and one for a character without a piece.

    The latter (its score lies 10 below the least, user-defined runs of blanks apart) is
    spelt in byte pieces. Scores are taken as log-probabilities and add up.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        self.arcs = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k == "normal"}
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == "unknown"), 0)
        self.unknown_score = min((s for _, s in self.arcs.values() if s > -1e8), default=0.0) - 10
        self.longest = max(map(len, self.arcs), default=1)
        self.prefixes = {p[:k] for p in self.arcs for k in range(1, len(p))}
        # no piece goes on from another character into a blank or holds a newline: texts fall apart there
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.arcs)
        self.raw = [bytes([int(p[3:-1], 16)]) if k == "byte" else b"" if k == "control" else "⁇".encode() if k == "unknown" else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.cache: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.ranked_before: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self._tables()

    def lattice(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each start: (end, score, ids) of its arcs."""
        out = []
        for a in range(len(s)):
            own = []
            for b in range(a + 1, min(len(s), a + self.longest) + 1):
                part = s[a:b]
                if (hit := self.arcs.get(part)) is not None:
                    own.append((b, hit[1], (hit[0],)))
                if part not in self.prefixes:
                    break
            if s[a] not in self.arcs:
                own.append((a + 1, self.unknown_score, self._spelt(s[a])))
            out.append(own)
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of characters as they stand (blanks as U+2581), best first.

        Backward A*: an open path runs from the end down to a node, and the Viterbi score
        from the start to that node is exactly the best it can still gain. So each path
        that reaches the start is the next best. Ties: the path whose ids come first.
        """
        lattice = self.lattice(s)
        best = [0.0] + [-np.inf] * len(s)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
        for a, own in enumerate(lattice):
            for b, score, ids in own:
                into[b].append((a, score, ids))
                best[b] = max(best[b], best[a] + score)
        heap, out = [(-best[len(s)], (), len(s), 0.0)], []
        while heap and len(out) < n:
            _, ids, node, gained = heapq.heappop(heap)
            if node == 0:
                out.append((gained, ids))
            for a, score, own in into[node]:
                heapq.heappush(heap, (-(best[a] + score + gained), own + ids, a, score + gained))
        return out

    def ranks(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """Scores and packed ids of the n best segmentations of a word, from what is known of it if it came before."""
        if (known := self.ranked.get((s, n))) is not None:
            return known
        if (known := self.ranked_before.get((s, n))) is None:
            known = [(x, np.array(ids, "<u4").tobytes()) for x, ids in self.nbest(s, n)]
        if len(s) <= CACHE_CHARS:
            if len(self.ranked) >= RANKED:
                self.ranked_before, self.ranked = self.ranked, {}
            self.ranked[s, n] = known
        return known

    def _tables(self) -> None:
        """The trie of pieces over letters of Latin scripts as one table, for words by the thousand."""
        self.letters = [c for c in self.arcs if len(c) == 1 and (c < "\u0250" or c == SPACE)][:255]
        code = {c: i + 1 for i, c in enumerate(self.letters)}
        self.codes = np.zeros(0x2582, np.uint8)
        for c, i in code.items():
            self.codes[ord(c)] = i
        children: list[dict[int, int]] = [{}, {}]  # 0: no piece goes on so; 1: the root
        hits: list[tuple[int, float]] = [(0, -np.inf), (0, -np.inf)]
        for p, hit in self.arcs.items():
            if all(c in code for c in p):
                node = 1
                for c in p:
                    if code[c] not in children[node]:
                        children[node][code[c]] = len(children)
                        children.append({})
                        hits.append((0, -np.inf))
                    node = children[node][code[c]]
                hits[node] = hit
        # 25 MB for 48,000 nodes and 255 letters, the one form in which these pieces are kept for look-up
        self.step = np.zeros((len(children), len(self.letters) + 1), np.min_scalar_type(len(children)))
        for node, own in enumerate(children):
            for c, to in own.items():
                self.step[node, c] = to
        self.hit_ids = np.array([i for i, _ in hits], np.uint32)
        self.hit_scores = np.array([x for _, x in hits])

    def learn(self, texts: list[list[str]]) -> None:
        """Segments the words that aren't known yet, those of one length and known letters together.

        Words in use come over from the older generation; a full generation becomes the older one.
        """
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        new = set().union(*texts).difference(self.cache)
        by: dict[int, list[str]] = {}
        for w in new:
            if (known := self.older.get(w)) is not None:
                self.cache[w] = known
            else:
                by.setdefault(len(w), []).append(w)
        for n, words in by.items():
            if n > 48:
                continue
            o = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n)
            codes = np.where(o < len(self.codes), self.codes[np.minimum(o, len(self.codes) - 1)], 0)
            fit = (codes > 0).all(1)
            if not fit.all():
                words, codes = [w for w, f in zip(words, fit.tolist(), strict=True) if f], codes[fit]
            for k in range(0, len(words), SIDE):
                self._words(words[k : k + SIDE], codes[k : k + SIDE])

    def _words(self, words: list[str], codes: np.ndarray) -> None:
        m, n = codes.shape
        best, tail = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, ids = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.uint32)
        best[0], tail[n] = 0.0, 0.0

        columns = np.ascontiguousarray(codes.T)
        arcs: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for a in range(n):
            node = np.ones(m, self.step.dtype)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                node = self.step[node, columns[b - 1]]
                if not node.any():
                    break
                score = self.hit_scores[node]
                arcs[a].append((b, score))
                score = score + best[a]
                up = np.flatnonzero(score > best[b])
                best[b, up], back[b, up], ids[b, up] = score[up], a, self.hit_ids[node[up]]
        rows, at, to = np.arange(m), np.full(m, n), np.zeros((n, m), np.int64)
        out, steps = np.zeros((m, n), np.uint32), np.zeros(m, np.int64)
        for k in range(n):
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            end = at[live]
            start = back[end, live]
            out[live, n - 1 - k] = ids[end, live]
            to[start, live] = end
            at[live] = start
            steps[live] += 1
        second = np.full(m, -np.inf)
        for a in range(n - 1, -1, -1):
            for b, score in arcs[a]:
                score = score + tail[b]
                np.maximum(tail[a], score, out=tail[a])
                # every other path has an arc off the best one
                np.maximum(second, np.where(to[a] == b, -np.inf, score + best[a]), out=second)
        raw, total = out.astype("<u4").tobytes(), best[n]
        gaps = (total - second).tolist()
        for i, (w, k, score, gap) in enumerate(zip(words, steps.tolist(), total.tolist(), gaps, strict=True)):
            self.cache[w] = (raw[4 * ((i + 1) * n - k) : 4 * (i + 1) * n], score, gap)

    def word(self, s: str) -> tuple[bytes, float, float]:
        """Of a word: packed ids and score of the best segmentation, what the second best lacks."""
        if (known := self.cache.get(s)) is not None:
            return known
        out = self._word(s)
        if len(s) <= CACHE_CHARS and len(self.cache) < CACHE:
            self.cache[s] = out
        return out

    def _word(self, s: str) -> tuple[bytes, float, float]:
        n, worst = len(s), float("-inf")
        best, back = [worst] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        froms, tos, scores, tokens = [], [], [], []
        for a in range(n):
            here, unknown = best[a], True
            for b in range(a + 1, min(n, a + self.longest) + 1):
                part = s[a:b]
                if (hit := self.arcs.get(part)) is not None:
                    if b == a + 1:
                        unknown = False
                    score = here + hit[1]
                    if score > best[b]:
                        best[b], back[b] = score, len(froms)
                    froms.append(a)
                    tos.append(b)
                    scores.append(hit[1])
                    tokens.append(hit[0])
                if part not in self.prefixes:
                    break
            if unknown:
                score = here + self.unknown_score
                if score > best[a + 1]:
                    best[a + 1], back[a + 1] = score, len(froms)
                froms.append(a)
                tos.append(a + 1)
                scores.append(self.unknown_score)
                tokens.append(self._spelt(s[a]))
        on, node = [], n
        while node:
            k = back[node]
            on.append(k)
            node = froms[k]
        on.reverse()
        # every other path has an arc off the best one
        tail, second, off = [worst] * n + [0.0], worst, set(on)
        for k in range(len(froms) - 1, -1, -1):
            a, gain = froms[k], scores[k] + tail[tos[k]]
            if gain > tail[a]:
                tail[a] = gain
            if k not in off and best[a] + gain > second:
                second = best[a] + gain
        ids = [x for k in on for x in (tokens[k] if type(tokens[k]) is tuple else (tokens[k],))]
        return np.array(ids, "<u4").tobytes(), best[n], best[n] - second

    def _spelt(self, ch: str) -> tuple[int, ...]:
        return tuple(self.bytes[x] for x in ch.encode()) if self.bytes else (self.unknown,)

    def words(self, text: str) -> list[str]:
        """Parts of the text between which no piece can lie; a blank goes before the first."""
        if not self.apart:
            return [(" " + text).replace(" ", SPACE)] if text else []
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            elif text:
                line = " " + line
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            if "" in rest:  # runs of blanks belong to the word that follows, or stand alone at the end
                held = ""
                for w in rest:
                    held += SPACE
                    if w:
                        out.append(held + w)
                        held = ""
                if held:
                    out.append(held)
            else:
                out += [SPACE + w for w in rest]
        return out

    def encode(self, text: str, n: int) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation of a whole text, and the scores of the n best.

        As no piece lies across words, the n best differ from the best in the n - 1 words
        of the least gaps only; these words' own n best form a lattice that is searched
        the same way.
        """
        return self.encode_words(self.words(text), n)

    def encode_words(self, names: list[str], n: int) -> tuple[np.ndarray, list[float]]:
        ids, scores = self.segmentations(names, n)
        return ids[0], scores

    def segmentations(self, names: list[str], n: int) -> tuple[list[np.ndarray], list[float]]:
        """Ids and scores of the n best segmentations of words, best first."""
        if not names:
            return [np.zeros(0, "<u4")], [0.0]
        try:
            packed, scores, gaps = zip(*map(self.cache.__getitem__, names), strict=True)
        except KeyError:
            packed, scores, gaps = zip(*map(self.word, names), strict=True)
        raw = b"".join(packed)
        ids = np.frombuffer(raw, "<u4")
        total = float(sum(scores))
        if n == 1:
            return [ids], [total]
        gaps = np.array(gaps)
        least = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
        least = [i for i in least.tolist() if gaps[i] < np.inf]
        # each combination: what it loses, and the words that it spells otherwise
        chosen: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        for i in least:
            found = ((max(0.0, scores[i] - x), own) for x, own in self.ranks(names[i], n))
            # the best segmentation goes first, also among equals
            others = [(loss, {i: own}) for loss, own in found if own != packed[i]]
            own = [(0.0, {}), *others]
            chosen = heapq.nsmallest(n, ((x + y, a | b) for x, a in chosen for y, b in own), key=lambda c: c[0])
        out = [ids]
        for _, words in chosen[1:]:
            parts, word, byte = [], 0, 0
            for i, own in sorted(words.items()):
                start = byte + sum(map(len, packed[word:i]))
                parts += [raw[byte:start], own]
                word, byte = i + 1, start + len(packed[i])
            out.append(np.frombuffer(b"".join([*parts, raw[byte:]]), "<u4"))
        return out, [total - x for x, _ in chosen]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces as text, byte pieces as the bytes they are, without the blank put before the first word."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


def encode_pieces(docs: DataFrame, pieces: list[tuple[str, float, str]], n_best: int = N_BEST, text: str = "text") -> DataFrame:
    """Adds piece_ids (array<int>), n_best_scores (array<double>, best first), decoded and n_best_ids (the ids of each of the n best).

    Null and empty texts have no ids, one score of 0 and decode to the empty text. All
    rows and other columns stay (columns of the four names are replaced); texts are
    read whole; no shuffle. The piece table, of fixed size, is broadcast. Fewer than
    `n_best` segmentations come back if the lattice has no more paths.
    """
    keep = [c for c in docs.columns if c.lower() not in ("piece_ids", "n_best_scores", "decoded", "n_best_ids")]
    docs = docs.select(*(f"`{c}`" for c in keep))
    schema = T.StructType(docs.schema.fields + T.DataType.fromDDL("piece_ids array<int>, n_best_scores array<double>, decoded string, n_best_ids array<array<int>>").fields)
    return docs.mapInArrow(_mapper(docs, pieces, n_best, text, schema, lambda p, body, ids, scores: (ids[0].astype("int32"), scores, p.decode(ids[0]), [x.astype("int32") for x in ids])), schema)


def piece_digest(docs: DataFrame, pieces: list[tuple[str, float, str]], n_best: int = N_BEST, text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), score, n_best_scores, round_trip (decoding gives the text back), n_best_sha256 (of the ids of each of the n best)."""
    schema = T.StructType([docs.schema["doc_id"]] + T.DataType.fromDDL("n_pieces long, ids_sha256 string, score double, n_best_scores array<double>, round_trip boolean, n_best_sha256 array<string>").fields)
    docs = docs.select("doc_id", text)
    return docs.mapInArrow(_mapper(docs, pieces, n_best, text, schema, lambda p, body, ids, scores: (len(ids[0]), _sha(ids[0]), scores[0], scores, p.decode(ids[0]) == body, [_sha(x) for x in ids]), 1), schema)


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.tobytes()).hexdigest()


def _mapper(docs: DataFrame, pieces: list, n_best: int, text: str, schema: T.StructType, make, old: int | None = None):
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        own, target = _worker(shared.value), to_arrow_schema(schema)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                bodies, size = [], 0
                while start + len(bodies) < batch.num_rows and size < BODIES:
                    bodies.append(batch.column(text)[start + len(bodies)].as_py() or "")
                    size += len(bodies[-1])
                part = batch.slice(start, len(bodies))
                start += len(bodies)
                words = [own.words(body) for body in bodies]
                own.learn(words)
                rows = [make(own, body, *own.segmentations(w, n_best)) for body, w in zip(bodies, words, strict=True)]
                held = list(part.columns)[:old]
                new = [pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), list(target)[len(held) :], strict=True)]
                yield pa.RecordBatch.from_arrays(held + new, names=target.names)
                touch()
        trim()

    return encode


def _worker(pieces: list) -> Pieces:
    """One table for all tasks of a Python worker, so that its words stay known until another operator begins."""
    return hold("pieces", hash((len(pieces), pieces[-1], pieces[len(pieces) // 2])) if pieces else 0, lambda: Pieces(pieces))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), load_pieces(MODEL))
