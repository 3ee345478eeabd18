"""SentencePiece encoding by sampling: Gumbel top-k without replacement over the lattice of a piece vocabulary.

A segmentation's weight is the product of its pieces' weights; a piece of merge rank r weighs
1 / (r + 2) (Zipf's law on the published order, to the power ``sharpness``). No piece has a blank inside, so the lattice of a text is a
chain of the lattices of its words, and backward sums are needed once for each different word.

The search is a perturbed A*: a node of the prefix tree carries the largest Gumbel-perturbed log
probability of all segmentations below it, the best node is expanded first, its children get
Gumbels conditioned on that maximum, and the leaves come off in order of their perturbed values:
samples without replacement. A node whose log probability lies so low that no noise a 24-bit uniform
number can give would bring it among the best k + 1 is not put on the frontier, and below
that point only the maximal child is drawn, word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.charlm import code_points
from skillgrid.llm.common import range_hashes, scramble, steps

BLANK = 0x2581
#: Largest Gumbel value of a uniform number of 24 bits.
TOP_NOISE = 17.4
STEP = 1 << 20
#: Lattice slots that a task keeps for words it meets again; bounds its memory, not its results.
KEPT_SLOTS = 600_000
_U = np.uint64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public piece model on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces of a model: sorted hashes of all their prefixes, and the log weight of each piece."""

    def __init__(self, path: str, sharpness: float = 0.5):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        real = [k for k in range(len(self.pieces)) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.bytes = np.array([next((k for k in range(len(self.pieces)) if self.pieces[k] == f"<0x{b:02X}>"), sp.unk_id()) for b in range(256)], np.int64)
        score = np.array([sp.get_score(k) for k in real])
        rank = np.empty(len(real))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(real))
        weight = -sharpness * np.log(rank + 2)
        total = np.log(np.exp(weight).sum())
        self.logp = np.full(len(self.pieces), -np.inf)
        self.logp[real] = weight - total
        self.byte_logp = float(-sharpness * np.log(len(real) + 2) - total)
        self.longest = max(len(self.pieces[k]) for k in real)
        where: dict[int, int] = {}
        for k in real:
            h = 0
            for c in self.pieces[k]:
                h = self._next(h, ord(c))
                where.setdefault(h, -1)
            where[h] = k
        self.keys = np.array(sorted(where), np.uint64)
        self.ids = np.array([where[int(h)] for h in self.keys], np.int64)
        top = (self.keys >> _U(44)).astype(np.int64)
        self.start = np.searchsorted(top, np.arange(1 << 20)).astype(np.int32)
        self.most = int(np.bincount(top).max())
        self.padded = np.concatenate([self.keys, np.zeros(self.most, np.uint64)])
        self.text = [self.pieces[k].replace("▁", " ").encode() for k in range(len(self.pieces))]
        for b, k in enumerate(self.bytes):
            self.text[k] = bytes([b])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the sorted prefix hashes, -1 for absent ones; the top 20 bits lead to a few candidates."""
        at = self.start[(h >> _U(44)).astype(np.int64)].astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        for n in range(self.most):
            np.copyto(out, at + n, where=self.padded[at + n] == h)
        return out

    @staticmethod
    def _next(h: int, c: int) -> int:
        return (h * 0x9E3779B97F4A7C15 + c * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)

    def decode(self, ids) -> str:
        """The text of an id sequence; the blank that encoding puts before a text is taken off."""
        return b"".join([self.text[k] for k in ids]).decode("utf-8", "replace")[1:]


class Lattice:
    """Edges and backward sums of the distinct words of a slice of texts.

    Slot i stands before a character of a word, or at the word's end. Its edges are rows of ``piece`` (id, or -2 -
    code for a character without a piece, which is written as bytes; -1: no edge), ``size`` (characters)
    and ``cond`` (log probability of going on with it).
    """

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n_slots = int((sizes + 1).sum())
        place = np.repeat(starts - self.first, sizes + 1) + np.arange(n_slots)
        self.rem = rem = np.repeat(self.first + sizes, sizes + 1) - np.arange(n_slots)  # characters left
        chars = np.zeros(n_slots + vocab.longest, np.uint64)
        if n_slots:
            chars[:n_slots] = np.where(rem > 0, codes[np.minimum(place, len(codes) - 1)], 0)
        lane = np.flatnonzero(rem > 0)
        h = np.zeros(len(lane), np.uint64)
        found = []
        for n in range(vocab.longest):
            h = h * _U(0x9E3779B97F4A7C15) + chars[lane + n] * _U(0xD6E8FEB86659FD93) + _U(1)
            at = vocab.find(h)
            hit = at >= 0
            piece = vocab.ids[at]
            piece[~hit] = -1
            if n == 0:
                bare = piece < 0
                code = chars[lane].astype(np.int64)
                cost = vocab.byte_logp * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
                found.append((lane, np.where(bare, -2 - code, piece), np.where(bare, cost, vocab.logp[piece])))
            else:
                put = piece >= 0
                found.append((lane[put], piece[put], vocab.logp[piece[put]]))
            go = hit & (rem[lane] > n + 1)
            lane, h = lane[go], h[go]
            if not len(lane):
                break
        degree = np.zeros(n_slots, np.int64)
        for slots, _, _ in found:
            degree[slots] += 1
        width = max(1, int(degree.max(initial=1)))
        self.piece = np.full((n_slots, width), -1, np.int32)
        self.size = np.zeros((n_slots, width), np.int64 if vocab.longest > 120 else np.int8)
        self.cond = np.full((n_slots, width), -np.inf, np.float32)
        degree[:] = 0
        for n, (slots, piece, logp) in enumerate(found, 1):
            nth = degree[slots]
            self.piece[slots, nth], self.cond[slots, nth], self.size[slots, nth] = piece, logp, n
            degree[slots] += 1
        beta = np.zeros(n_slots + 1)
        order = np.argsort(rem, kind="stable")
        bounds = np.searchsorted(rem[order], np.arange(1, int(rem.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            idx = order[a:b]
            v = self.cond[idx] + beta[idx[:, None] + self.size[idx]]
            top = v.max(axis=1)
            beta[idx] = top + np.log(np.exp(v - top[:, None]).sum(axis=1))
            self.cond[idx] = v - beta[idx][:, None]
        self.cdf = np.cumsum(np.exp(self.cond), axis=1, dtype=np.float32)
        self.cdf[np.arange(n_slots), np.maximum(degree - 1, 0)] = 2.0  # rounding never leads past the last edge
        self.cdf = np.maximum.accumulate(self.cdf, axis=1)


class Net:
    """Lattices of the words met so far; ``place`` adds those of new words and starts anew when too many are held."""

    PARTS = ("piece", "size", "cond", "cdf")

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.hashes = vocab, np.zeros(0, np.uint64)

    def place(self, h: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """First slot of each of the different words with sorted hashes ``h``."""
        if len(self.hashes) and len(self.rem) > KEPT_SLOTS:
            self.hashes = np.zeros(0, np.uint64)
        have = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            have = self.hashes[at] == h
        new = Lattice(self.vocab, codes, starts[~have], sizes[~have])
        if not len(self.hashes):
            self.hashes, self.starts, self.rem = h, new.first, new.rem
            for part in self.PARTS:
                setattr(self, part, getattr(new, part))
            return self.starts
        merged = np.concatenate([self.hashes, h[~have]])
        order = np.argsort(merged, kind="stable")
        self.starts = np.concatenate([self.starts, new.first + len(self.rem)])[order]
        self.hashes, self.rem = merged[order], np.concatenate([self.rem, new.rem])
        width = max(self.piece.shape[1], new.piece.shape[1])
        for part, empty in zip(self.PARTS, (-1, 0, -np.inf, 2.0)):
            both = [getattr(self, part), getattr(new, part)]
            both = [x if x.shape[1] == width else np.concatenate([x, np.full((len(x), width - x.shape[1]), empty, x.dtype)], axis=1) for x in both]
            setattr(self, part, np.concatenate(both))
        return self.starts[np.searchsorted(self.hashes, h)]


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((scramble(key) >> _U(40)).astype(np.float64) + 0.5) * 2.0**-24


class Sampler:
    """Samples of the texts of one slice."""

    def __init__(self, net: Net, text: pa.Array, seeds: np.ndarray, k: int):
        codes, bounds = code_points(text, 1)
        codes[codes == 32] = BLANK
        size = np.diff(bounds)
        self.begin = bounds[:-1] + np.arange(len(size))  # of each text with its leading blank
        self.end = self.begin + np.where(size > 0, size + 1, 0)
        codes[self.begin] = BLANK
        start = codes == BLANK
        start[1:] &= codes[:-1] != BLANK
        start[self.begin] = True
        at = np.flatnonzero(start)
        owner = np.searchsorted(self.begin, at, "right") - 1
        keep = at < self.end[owner]
        at, owner = at[keep], owner[keep]
        stop = np.minimum(np.append(at[1:], len(codes)), self.end[owner]) if len(at) else at
        self.word_of = np.searchsorted(owner, np.arange(len(size) + 1))  # first word of each text
        h = range_hashes(codes, at, stop)
        different, one, kind = np.unique(h, return_index=True, return_inverse=True)
        #: First lattice slot of every word of the slice.
        self.slot_of = net.place(different, codes, at[one], (stop - at)[one])[kind]
        self.net, self.vocab, self.seeds, self.k, self.n = net, net.vocab, seeds, k, len(size)
        self.n_words = np.diff(self.word_of)

    def run(self):
        """For each sample: the texts that have one, their ids (flat) and bounds, log probability and perturbed value; then the threshold of each text."""
        n, k = self.n, self.k
        none = -np.inf
        self.value = np.full((n, k), none)  # frontier, best first
        self.phi = np.zeros((n, k))
        self.from_, self.step, self.word, self.slot, self.edge = (np.zeros((n, k), np.int64) for _ in range(5))
        self.paths = []
        live = np.flatnonzero(self.n_words > 0)
        # the perturbed maximum of the whole lattice: Gumbel of log weight 0
        root = -np.log(-np.log(_uniform(self.seeds ^ _U(0xA5A5A5A5))))
        out = []
        for s in range(k):
            if s == 0:
                docs, value, phi = live, root[live], np.zeros(len(live))
                word, slot = np.zeros(len(live), np.int64), None
                front = np.full((n, 8), -1, np.int32)
                used = np.zeros(n, np.int64)
            else:
                docs = live[self.value[live, 0] > none]
                value, phi, word, slot = self.value[docs, 0], self.phi[docs, 0], self.word[docs, 0], self.slot[docs, 0]
                used = np.zeros(n, np.int64)
                used[docs] = self.step[docs, 0] + 1
                front = np.full((n, max(8, int(used.max(initial=0)))), -1, np.int32)
                for d in docs:
                    old = self.paths[self.from_[d, 0]]
                    t = self.step[d, 0]
                    front[d, :t] = old[d, :t]
                    front[d, t] = self.edge[d, 0]
                for a in (self.value, self.phi, self.from_, self.step, self.word, self.slot, self.edge):
                    a[docs, :-1] = a[docs, 1:]
                self.value[docs, -1] = none
            word, phi, front, used = self._front(s, docs, value.copy(), phi.copy(), word.copy(), slot, front, used)
            self.paths.append(front)
            out.append((docs, value, *self._tail(s, docs, word, phi, front, used)))
        return out, np.where(np.isfinite(self.value[:, 0]), self.value[:, 0], none)

    def _front(self, s, docs, value, phi, word, slot, front, used):
        """Expands node after node of each text's best path, with all children, until no child can matter; then to the end of the word."""
        net, k = self.net, self.k
        width = net.piece.shape[1]
        slot = self.slot_of[self.word_of[docs] + word] if slot is None else slot.copy()
        active = np.arange(len(docs))
        # a path may begin at the end of a word
        while len(active):
            ended = net.rem[slot[active]] == 0
            moved = active[ended]
            word[moved] += 1
            more = word[moved] < self.n_words[docs[moved]]
            go = moved[more]
            slot[go] = self.slot_of[self.word_of[docs[go]] + word[go]]
            open_ = phi[active] + TOP_NOISE > self.value[docs[active], k - 1]
            fresh = np.ones(len(active), bool)
            fresh[ended] = more
            inside = net.rem[slot[active]] > 0
            at_start = slot[active] == self.slot_of[np.minimum(self.word_of[docs[active]] + word[active], len(self.slot_of) - 1)]
            active = active[fresh & inside & (open_ | ~at_start)]
            if not len(active):
                break
            d = docs[active]
            cond = net.cond[slot[active]].astype(np.float64)
            noise = _uniform((self.seeds[d] + _U((s * 0x9E37 + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))[:, None] + ((used[d] + 1)[:, None] * 64 + np.arange(width)).astype(np.uint64) * _U(0x8CB92BA72F3D8DD7))
            child = phi[active][:, None] + cond
            g = child - np.log(-np.log(noise))
            z = g.max(axis=1)
            best = g.argmax(axis=1)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                v = value[active][:, None] - g + np.log1p(-np.exp(g - z[:, None]))
                kept_ = value[active][:, None] - np.maximum(0, v) - np.log1p(np.exp(-np.abs(v)))
            row = np.arange(len(active))
            kept_[row, best] = -np.inf
            kept_[~np.isfinite(cond)] = -np.inf
            self._push(s, d, kept_, child, used[d], word[active], slot[active])
            if used[d].max() >= front.shape[1]:
                front = np.concatenate([front, np.full_like(front, -1)], axis=1)
            front[d, used[d]] = net.piece[slot[active], best]
            used[d] += 1
            phi[active] = child[row, best]
            slot[active] += net.size[slot[active], best]
        return word, phi, front, used

    def _push(self, s, d, values, phis, step, word, slot):
        """Siblings enter the frontier of their text, which keeps its best k nodes."""
        better = values.max(axis=1) > self.value[d, -1]
        if not better.any():
            return
        d, values, phis, step, word, slot = d[better], values[better], phis[better], step[better], word[better], slot[better]
        k = self.k
        every = np.concatenate([self.value[d], values], axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, :k]
        row = np.arange(len(d))[:, None]
        shape = values.shape
        piece = self.net.piece[slot]
        fresh = (phis, np.full(shape, s), np.broadcast_to(step[:, None], shape), np.broadcast_to(word[:, None], shape), slot[:, None] + self.net.size[slot], piece)
        for own, new in zip((self.phi, self.from_, self.step, self.word, self.slot, self.edge), fresh):
            own[d] = np.concatenate([own[d], new], axis=1)[row, order]
        self.value[d] = every[row, order]

    def _tail(self, s, docs, word, phi, front, used):
        """Draws the remaining words of each text and puts the pieces of the whole path in order."""
        net = self.net
        left = np.maximum(self.n_words[docs] - word, 0)
        owner = np.repeat(np.arange(len(docs)), left)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(left) - left, left) + np.repeat(word, left)
        seed = scramble(self.seeds[docs][owner] + _U((s + 1) * 0xA0761D6478BD642F & (2**64 - 1))) + nth.astype(np.uint64) * _U(0xE7037ED1A0B428DB)
        slot = self.slot_of[self.word_of[docs][owner] + nth] if len(owner) else np.zeros(0, np.int64)
        logp, count = np.zeros(len(owner)), np.zeros(len(owner), np.int64)
        lanes, taken = np.arange(len(owner)), []
        step = 0
        while len(lanes):
            u = _uniform(seed[lanes] + _U(step * 0x1000001B3 & (2**64 - 1)))
            at = slot[lanes]
            pick = (net.cdf[at] <= u[:, None]).sum(axis=1)
            taken.append((lanes, net.piece[at, pick]))
            logp[lanes] += net.cond[at, pick]
            count[lanes] += 1
            slot[lanes] = at + net.size[at, pick]
            lanes = lanes[net.rem[slot[lanes]] > 0]
            step += 1
        per_doc = np.bincount(owner, weights=count, minlength=len(docs)).astype(np.int64)
        total = phi + np.bincount(owner, weights=logp, minlength=len(docs))
        ahead = used[docs]
        bounds = np.concatenate([[0], np.cumsum(per_doc + ahead)])
        ids = np.empty(bounds[-1], np.int64)
        lane_at = np.cumsum(count) - count  # place of a word among all drawn pieces
        shift = (bounds[:-1] + ahead - (np.cumsum(per_doc) - per_doc))
        for step, (lanes, piece) in enumerate(taken):
            ids[lane_at[lanes] + shift[owner[lanes]] + step] = piece
        spot = np.arange(int(ahead.sum())) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        ids[np.repeat(bounds[:-1], ahead) + spot] = front[np.repeat(docs, ahead), spot]
        return total, *self._with_bytes(ids, bounds)

    def _with_bytes(self, ids, bounds):
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, bounds
        raw = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in ids[bare]]
        more = np.ones(len(ids), np.int64)
        more[bare] = [len(r) for r in raw]
        lead = np.concatenate([[0], np.cumsum(more)])
        out = np.repeat(ids, more)
        for at, r in zip(lead[bare], raw):
            out[at:at + len(r)] = self.vocab.bytes[list(r)]
        return out, lead[bounds]


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 2, model: str | None = None, sharpness: float = 0.5, seed: int = 0) -> DataFrame:
    """(id, rank, ids, log_prob, perturbed, log_inclusion, decoded) of up to ``k`` different segmentations of every text.

    The samples of a row are drawn without replacement, in the order of their Gumbel-perturbed log
    probabilities; the random numbers depend on the row's id and ``seed`` only. log_inclusion is the
    log of 1 - exp(-exp(log_prob - threshold)), the probability that a segmentation exceeds the
    next perturbed value; 0 where there is no other segmentation. ``decoded`` is the text of the ids; it equals the text
    but for U+2581, which reads as a blank. A text with fewer than ``k`` segmentations
    has them all; an empty or null text has one, of no pieces. Repeated ids with equal texts get equal samples; a null id
    is an id of its own. An empty table gives an empty table. A task holds about 100 bytes for each character of the
    different words of a slice of 1 MB, or of one longer text, and those of the words before, up to a bound.
    """

    path = model

    def run(batches):
        net = Net(Vocabulary(path or model_path(), sharpness))
        for batch in steps(batches, "t", STEP):
            texts = batch.column("t")
            full = texts.fill_null("")
            seeds = scramble(batch.column("s").to_numpy(zero_copy_only=False).astype(np.uint64))
            samples, threshold = Sampler(net, full, seeds, k).run()
            blank = np.flatnonzero([not x for x in full.to_pylist()])
            for rank, (who, value, logp, ids, bounds) in enumerate(samples, 1):
                with np.errstate(over="ignore", divide="ignore"):
                    gap = logp - threshold[who]
                    inclusion = np.where(gap < -20, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
                pieces = net.vocab.text
                flat = ids.tolist()
                decoded = [b"".join([pieces[x] for x in flat[a:b]]).decode("utf-8", "replace")[1:] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                if rank == 1 and len(blank):
                    who = np.concatenate([who, blank])
                    value, logp, inclusion = (np.concatenate([x, np.zeros(len(blank))]) for x in (value, logp, inclusion))
                    bounds = np.concatenate([bounds, np.full(len(blank), bounds[-1])])
                    decoded += [""] * len(blank)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(who)), pa.array(np.full(len(who), rank, np.int32)), lists, pa.array(logp), pa.array(value), pa.array(inclusion), pa.array(decoded, pa.string())],
                                                 ["i", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "decoded"])

    rows = docs.select(F.col(id).alias("i"), F.xxhash64(F.col(id).cast("string"), F.lit(seed)).alias("s"), F.col(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    out = rows.mapInArrow(run, f"i {kind}, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded string")
    return out.withColumnRenamed("i", id)
