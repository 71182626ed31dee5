"""SentencePiece encoding and decoding, and distinct sampled segmentations by a perturbed search over the lattice.

A text's segmentations are the paths of a lattice of pieces. Pieces have the probabilities of Zipf's law at their rank in
the vocabulary; backward sums make each place's edges a distribution, so a path's probability is the product of its
steps. The search draws the Gumbel-perturbed log-probabilities of paths from the top down: the best path inherits the
perturbed maximum of the whole lattice, and at each of its steps the paths that leave it there get theirs, a Gumbel
variable cut off at that maximum. The largest of all that wait is the next best path's, which is then drawn below its
branch, and so on: K rounds give the K segmentations of largest perturbed log-probability, a sample without replacement.
The next largest is the threshold of the inclusion scores. All draws are functions of the row's key.

Blanks start pieces and never end them (but for runs of blanks), so the lattice of a text is a chain of the lattices of
its words, and equal words of a batch share theirs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.words import mix, small_batches

SAMPLES = 2
BLANK = "▁"
#: Bytes of text of a batch that are searched at once (a longer text is searched by itself).
BLOCK = 3_000_000
#: Places of the lattices that are built at once.
PLACES = 1 << 17
#: Steps at a path's start that bound its best branches from below. A later branch needs a Gumbel draw of more than NO_CHANCE
#: to come into question: a chance of exp(-32), about 1e-14 a branch, below the precision of the sums, and not drawn.
AHEAD, NO_CHANCE = 32, 32.0
FILTER_BITS = 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as tables: hashed strings by length, log-probabilities, byte pieces, and the pieces' UTF-8 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, dtype=np.int32)
        plain = []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        self.longest = max(len(self.names[i]) for i in plain)
        rank = np.full(n, n, dtype=float)
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        rank[order] = np.arange(len(order))
        share = 1.0 / (rank + 1)
        special = np.ones(n, dtype=bool)
        special[plain] = False
        special[self.byte_id] = False
        share[special] = 0
        with np.errstate(divide="ignore"):
            self.logp = np.log(share / share.sum())
        self.tables = []
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        for size in range(1, self.longest + 1):
            ids = np.array([i for i in plain if len(self.names[i]) == size], dtype=np.int32)
            if not len(ids):
                self.tables.append((np.empty(0, dtype=np.uint64), ids))
                continue
            codes = np.array([[ord(c) for c in self.names[i]] for i in ids], dtype=np.uint64)
            h = np.zeros(len(ids), dtype=np.uint64)
            for j in range(size):
                h = h * _P + (codes[:, j] + np.uint64(1))
            h = h * _Q
            self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            o = np.argsort(h)
            self.tables.append((h[o], ids[o]))
        raw = [bytes([int(self.names[i][1:-1], 16)]) if model.is_byte(i) else self.names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.raw_size = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_size)])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 bytes of ids in a row, and where each id's bytes start (one more than ids)."""
        sizes = self.raw_size[ids]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return self.raw[np.arange(starts[-1]) + np.repeat(self.raw_start[ids] - starts[:-1], sizes)].tobytes(), starts

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text's ids, without the blank that encoding puts before the text."""
        out, _ = self.bytes_of(ids)
        return out[1:] if out[:1] == b" " else out


class Lattices:
    """The lattices of the distinct words of a batch (longest first, each with a blank before it that ``words`` leaves out),
    laid end to end: for each place and length of an edge its piece, the logarithm of its probability there, and the cumulated
    probabilities of the lengths up to it."""

    def __init__(self, pieces: Pieces, words: list[str]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer((BLANK + BLANK.join(words) if words else "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n, most = len(codes), pieces.longest
        self.left = (np.repeat(self.start[1:], sizes) - np.arange(n)).astype(np.int32)  # places to the word's end
        self.piece = np.full((n, most), -1, dtype=np.int32)
        self.logp = np.full((n, most), -np.inf, dtype=np.float32)
        self.cum = np.full((n, most), 2.0, dtype=np.float32)
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, n + PLACES, PLACES))) if n else np.array([0])
        for a, b in zip(self.start[np.minimum(cuts[:-1], len(words))], self.start[np.minimum(cuts[1:], len(words))]):
            if b > a:
                self._build(pieces, codes[a:b], slice(a, b))

    def _build(self, pieces: Pieces, codes: np.ndarray, at_: slice) -> None:
        """Edges and probabilities of whole words at once, in views of their rows.

        The sums run over the places by their distance to the word's end. As longer words come first, the places at a
        distance k belong to the first words, so what follows them is the front of the places nearer to the end.
        """
        piece, out, cum, left = self.piece[at_], self.logp[at_], self.cum[at_], self.left[at_]
        n, most = len(codes), pieces.longest
        order = np.argsort(left.astype(np.uint16) if left[0] < 2**16 else left, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(left))])
        spot = np.empty(n, dtype=np.int64)
        spot[order] = np.arange(n)
        logp = np.full((most, n), -np.inf)  # by length and by distance
        places, h, reach = np.arange(n), np.zeros(n, dtype=np.uint64), left
        for size in range(1, most + 1):
            if size > 1:
                on = np.flatnonzero(reach >= size)
                places, h, reach = places[on], h[on], reach[on]
            if not len(places):
                break
            h *= _P
            h += codes[places + (size - 1)]
            h += np.uint64(1)
            table, ids = pieces.tables[size - 1]
            if not len(table):
                continue
            hashed = h * _Q
            at = np.flatnonzero(pieces.filter[hashed >> np.uint64(64 - FILTER_BITS)])
            hashed = hashed[at]
            near = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
            hit = table[near] == hashed
            at, found = places[at[hit]], ids[near[hit]]
            piece[at, size - 1] = found
            logp[size - 1, spot[at]] = pieces.logp[found]
        bare = np.flatnonzero(piece[:, 0] == -1)  # no piece of their own: their bytes
        if len(bare):
            c = codes[bare].astype(np.int64)
            width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            piece[bare, 0] = np.where(width == 1, pieces.byte_id[np.minimum(c, 127)], -2 - c)
            logp[0, spot[bare]] = width * pieces.logp[pieces.byte_id[0]]
        back: list[np.ndarray] = []  # by distance, the nearest last
        for k in range(1, len(ends) - 1):
            lo, hi = ends[k], ends[k + 1]
            values = logp[: min(k, most), lo:hi]
            for size in range(1, min(k - 1, most) + 1):
                values[size - 1] += back[-size][: hi - lo]
            top = values.max(axis=0)
            share = np.exp(values - top)
            np.cumsum(share, axis=0, out=share)
            total = share[-1]
            logs = top + np.log(total)
            back = [*back[1 - most :], logs]
            values -= logs
            last = share >= total  # from the last edge on
            share /= total
            share[last] = np.inf
            own = order[lo:hi]
            out[own, : len(values)] = values.T
            cum[own, : len(values)] = share.T

    def others(self, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The probability of the other edges at each place, summed without the edge itself."""
        own = np.exp(self.logp[place, k].astype(np.float64))
        out = 1.0 - own
        sure = np.flatnonzero(own > 0.9)  # there the difference is too coarse
        p = np.exp(self.logp[place[sure]])
        p[np.arange(len(sure)), k[sure]] = 0
        out[sure] = p.sum(axis=1)
        return out


def _uniform(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _hashed_uniform(*parts)


def _hashed_uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1), each a function of the given integers."""
    h = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        h = mix((h ^ np.asarray(p).astype(np.uint64)) * _P + np.uint64(1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _count_true(rows: np.ndarray) -> np.ndarray:
    """How many of each row are true; rows of 8 or 16 are counted as words of bits."""
    if rows.shape[1] % 8:
        return rows.sum(axis=1)
    packed = np.bitwise_count(np.ascontiguousarray(rows).view(np.uint64))
    out = packed[:, 0].astype(np.int64)
    for c in range(1, packed.shape[1]):
        out += packed[:, c]
    return out


def _walk(lat: Lattices, seed: np.ndarray, number: int, occ: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random steps from ``place`` to the end of the word for each occurrence: (occurrence, place, length - 1), in order.

    ``seed`` holds the text's key and the occurrence's number in it, so a draw depends on the key and the place in the text
    alone, not on the batch."""
    out = []
    while len(occ):
        left = lat.left[place]
        u = _uniform(seed[occ], number, left).astype(np.float32)
        k = _count_true(lat.cum[place] <= u[:, None])
        out.append((occ, place, k))
        on = np.flatnonzero(left > k + 1)
        occ, place = occ[on], (place + k + 1)[on]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3


def search(lat: Lattices, word: np.ndarray, owner: np.ndarray, texts: int, key: np.ndarray, samples: int):
    """For each round (place, length - 1, bounds by text, perturbed, log-probability, drawn); and at last the thresholds.

    ``word``: the lattice of each occurrence; ``owner``: its text; ``key``: a 64-bit number for each text. ``drawn`` is
    false where a text has no further segmentation; its steps are then empty.
    """
    seed = key[owner]
    local = np.arange(len(owner)) - np.searchsorted(owner, owner)  # the occurrence's number in its text
    mixed = mix(seed ^ mix(local.astype(np.uint64) + np.uint64(7)))
    first = np.searchsorted(owner, np.arange(texts + 1))
    perturbed = -np.log(-np.log(_uniform(key, 1)))
    drawn = np.ones(texts, dtype=bool)
    wait: list[list] = [[] for _ in range(texts)]  # (perturbed, path, step, left-out edges)
    occ, place, k = _walk(lat, mixed, 0, np.arange(len(word)), lat.start[word])
    fresh, spared = None, {}
    paths, rounds = [], []
    for number in range(samples):
        order = np.argsort(occ, kind="stable")
        occ, place, k = occ[order], place[order], k[order]
        who = owner[occ]
        bounds = np.searchsorted(occ, first)
        steps = lat.logp[place, k].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(steps)])
        begins = bounds[:-1] if fresh is None else np.maximum(fresh, bounds[:-1])

        def values(at):
            """The perturbed log-probability of what leaves the path at each step of ``at``."""
            t = who[at]
            mass = lat.others(place[at], k[at])
            for x in np.flatnonzero(np.isin(at, special)):
                own = np.exp(lat.logp[place[at[x]]].astype(np.float64))
                own[[*spared[t[x]][1], k[at[x]]]] = 0
                mass[x] = own.sum()
            with np.errstate(divide="ignore"):
                mu = total[at] - total[bounds[:-1]][t] + np.log(mass)
                noise = np.log(-np.log(_uniform(mixed[occ[at]], 1000 + number, lat.left[place[at]])))
                return np.where(mass > 0, -np.logaddexp(-perturbed[t], noise - mu), -np.inf)

        special = np.array([x for x, _ in spared.values()], dtype=np.int64)
        reach = np.minimum(bounds[1:] - begins, AHEAD)
        reach = np.where(drawn, np.maximum(reach, 0), 0)
        early = np.repeat(begins - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        value = values(early)
        grid = np.full((texts, AHEAD), -np.inf)
        grid[who[early], early - begins[who[early]]] = value
        low = -np.partition(-grid, samples, axis=1)[:, samples]
        # later steps come into question only where a branch can still beat that bound
        late = total[:-1] - total[bounds[:-1]][who] > low[who] - NO_CHANCE
        late &= np.arange(len(late)) >= (begins + reach)[who]
        late = np.flatnonzero(late)
        at, value = np.concatenate([early, late]), np.concatenate([value, values(late)])
        rounds.append((place, k, bounds, perturbed.copy(), total[bounds[1:]] - total[bounds[:-1]], drawn.copy()))
        paths.append((occ, place, k, bounds))
        good = np.flatnonzero((value >= low[who[at]]) & np.isfinite(value))
        for t, v, x in zip(who[at[good]].tolist(), value[good].tolist(), at[good].tolist()):
            wait[t].append((v, number, x, (*spared[t][1], int(k[x])) if t in spared and spared[t][0] == x else (int(k[x]),)))
        if number == samples - 1:
            break
        drawn = np.array([bool(w) for w in wait])
        perturbed = np.full(texts, -np.inf)
        parts, forced = [], []
        fresh, spared = np.zeros(texts, dtype=np.int64), {}
        keep = [np.zeros(len(p[0]), dtype=bool) for p in paths]
        begin = np.full(texts, len(word), dtype=np.int64)  # the first occurrence that is drawn anew
        for t in np.flatnonzero(drawn):
            best = max(range(len(wait[t])), key=lambda i: wait[t][i][0])
            v, path, step, out = wait[t].pop(best)
            perturbed[t] = v
            o, pl, _, b = paths[path]
            keep[path][b[t] : step] = True
            p = np.exp(lat.logp[pl[step]].astype(np.float64))
            p[list(out)] = 0
            c = np.cumsum(p)
            u = float(_uniform(key[t], 77, number))
            edge = int(np.searchsorted(c, u * c[-1], side="right"))
            while edge >= len(p) or p[edge] <= 0:
                edge -= 1
            forced.append((int(o[step]), int(pl[step]), edge))
            spared[t] = (int(step - b[t]), out)
            begin[t] = o[step] + 1
        for (o, pl, kk, _), m in zip(paths, keep):
            if m.any():
                parts.append((o[m], pl[m], kk[m]))
        if forced:
            fo = tuple(np.array(c, dtype=np.int64) for c in zip(*forced))
            parts.append(fo)
            on = lat.left[fo[1]] > fo[2] + 1
            again = np.flatnonzero(np.arange(len(word)) >= begin[owner])
            parts.append(_walk(lat, mixed, number + 1, np.concatenate([fo[0][on], again]), np.concatenate([(fo[1] + fo[2] + 1)[on], lat.start[word[again]]])))
        occ, place, k = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, dtype=np.int64),) * 3
        bounds = np.searchsorted(np.sort(occ), first)
        for t in spared:
            at = int(bounds[t]) + spared[t][0]
            fresh[t] = at
            spared[t] = (at, spared[t][1])
        fresh[~drawn] = bounds[1:][~drawn]
    threshold = np.array([max((w[0] for w in ws), default=-np.inf) for ws in wait])
    return rounds, threshold


def _ids(pieces: Pieces, lat: Lattices, place: np.ndarray, k: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of steps, and the bounds of the texts in them; a code point without a piece becomes its bytes."""
    ids = lat.piece[place, k]
    odd = np.flatnonzero(ids < -1)
    if not len(odd):
        return ids, bounds
    raw = [pieces.byte_id[np.frombuffer(chr(-2 - int(c)).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in ids[odd]]
    more = np.zeros(len(ids) + 1, dtype=np.int64)
    more[odd + 1] = [len(r) - 1 for r in raw]
    moved = np.cumsum(more)
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[odd] = [len(r) for r in raw]
    out = np.repeat(ids, sizes)
    for at, r in zip(odd + moved[odd], raw):
        out[at : at + len(r)] = r
    return out, bounds + moved[bounds]


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, longest first, each with the blanks before it but for the first one, the word of each occurrence, and
    its text."""
    texts = texts.cast(pa.large_string())
    texts = pc.if_else(pc.equal(texts, ""), None, pc.replace_substring(texts, BLANK, " "))
    lists = pc.split_pattern(texts, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    word, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(texts)), sizes)
    words = vocabulary
    if "" in vocabulary:  # blanks in a row: they go before the next word, or end the text
        none = vocabulary.index("")
        more: dict[tuple[int, int], int] = {}
        drop = np.zeros(len(word), dtype=bool)
        last = np.append(owner[1:] != owner[:-1], True)
        blanks = 0
        for at in np.flatnonzero((word == none) | np.append(False, word[:-1] == none)).tolist():
            if word[at] == none and not last[at]:
                blanks += 1
                drop[at] = True
            elif blanks:
                key = (int(word[at]), blanks)
                if key not in more:
                    more[key] = len(words)
                    words.append(BLANK * blanks + vocabulary[key[0]])
                word[at], blanks = more[key], 0
        word, owner = word[~drop], owner[~drop]
    order = np.argsort(-np.fromiter(map(len, words), dtype=np.int64, count=len(words)), kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    return [words[k] for k in order.tolist()], rank[word], owner


def _sampled(pieces: Pieces, texts: pa.Array, keys: list, samples: int) -> list[tuple]:
    """For each round (ids of all texts, bounds of the texts in them, log-probabilities, perturbed, log-inclusions, drawn)."""
    words, word, owner = _words(texts)
    lat = Lattices(pieces, words)
    key = np.array([xxhash.xxh3_64_intdigest(repr(x).encode()) for x in keys], dtype=np.uint64)
    rounds, threshold = search(lat, word, owner, len(texts), key, samples)
    with np.errstate(over="ignore", divide="ignore"):
        return [(*_ids(pieces, lat, place, k, bounds), lp, g, _log_inclusion(lp - threshold), drawn) for place, k, bounds, g, lp, drawn in rounds]


def sampled_texts(pieces: Pieces, texts: list[str | None], keys: list, samples: int = SAMPLES):
    """Yield for each text a list of (ids, log-probability, perturbed, log-inclusion), best first; an empty text has one, of no ids."""
    rounds = _sampled(pieces, pa.array(texts, pa.large_string()), keys, samples)
    for t in range(len(texts)):
        yield [(ids[b[t] : b[t + 1]], float(lp[t]), float(g[t]), float(inc[t])) for ids, b, lp, g, inc, drawn in rounds if drawn[t]]


def _log_inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x))), the chance that a path of log-probability x above the threshold is among the sample."""
    e = np.exp(np.minimum(x, 50.0))
    return np.where(x < -20, x, np.log(-np.expm1(-e)))


SAMPLED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sample", T.IntegerType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("log_prob", T.DoubleType()),
        T.StructField("perturbed", T.DoubleType()),
        T.StructField("log_inclusion", T.DoubleType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def sampled_segmentations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Up to ``samples`` rows for each row of ``docs``: doc_id, sample (from 1, by descending perturbed log-probability),
    n_pieces, ids_crc32 (little-endian 32-bit ids), log_prob, perturbed, log_inclusion, round_trip (the decoded ids are the
    text), and on demand ids.

    The draws depend on the id (of a row without one, on its text), so repeated rows have equal samples. A text with fewer
    segmentations has fewer rows; null and empty texts have one, of no pieces. The blank sign U+2581 in a text is read as a
    blank, so such texts don't round trip. Samples of equal perturbed log-probability, which have chance 0, are in no stated order. A text of any length is segmented whole, word by word. A branch that would need a Gumbel draw
    of more than ``NO_CHANCE`` (a chance of 1e-14) isn't drawn. Ids must be integers or null. An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    path = model_path or default_model()
    schema = T.StructType([*SAMPLED.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else SAMPLED

    def sample(batches):
        pieces = Pieces(path)
        for batch in small_batches(batches, 1, BLOCK):
            texts = batch.column(1)
            raw = pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()
            keys = [texts[k].as_py() if i is None else i for k, i in enumerate(batch.column(0).to_pylist())]
            for number, (ids, bounds, lp, g, inc, drawn) in enumerate(_sampled(pieces, texts, keys, samples), 1):
                own = np.flatnonzero(drawn)
                packed = ids.astype("<u4").tobytes()
                decoded, starts = pieces.bytes_of(ids)
                ends = starts[bounds].tolist()
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(bounds[own].tolist(), bounds[own + 1].tolist())]
                whole = [decoded[ends[t] + 1 : ends[t + 1]] == raw[t] for t in own.tolist()]  # without the blank that stands before a text
                columns = [batch.column(0).take(pa.array(own)), pa.array(np.full(len(own), number, dtype=np.int32)), pa.array(np.diff(bounds)[own].astype(np.int64)), pa.array(crc, pa.int64())]
                columns += [pa.array(x[own].astype(np.float64)) for x in (lp, g, inc)] + [pa.array(whole, pa.bool_())]
                if with_ids:
                    columns.append(pa.array([ids[bounds[t] : bounds[t + 1]] for t in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(sample, schema)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id and ids: the library's own (unsampled) encoding of each whole text; null texts have no ids."""
    path = model_path or default_model()

    def encode(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in small_batches(batches, 1):
            ids = model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids; null ids give an empty text."""
    path = model_path or default_model()

    def decode(batches):
        pieces = Pieces(path)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long"), F.col(ids)).mapInArrow(decode, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return sampled_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
