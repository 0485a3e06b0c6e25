"""A causal self-attention model over subword ids in numpy: one layer, a factored softmax with learned output vectors, hand-written gradients.

A text is a stream of target ids; the input of a target is the id before it, that of the first the end id. Blocks of STRIDE targets are
scored each in a window of WINDOW inputs: those of the block, seen causally, and those of the block before. So windows overlap by half,
each target is scored once, with STRIDE to WINDOW - 1 inputs before it as context (less at a text's beginning), and a text's score does not
depend on which texts share its batch.

The next id's distribution is that of its class times that of the id in its class, both softmaxes over learned vectors. Classes bin the ids
by frequency, so that frequent ids have small classes; the biases start as the log frequencies of all training texts.
"""

from __future__ import annotations

import numpy as np

#: Inputs of a window, and how far the next window moves on. Width of the vectors, and classes of ids.
WINDOW, STRIDE = 32, 16
WIDTH, CLASSES = 16, 48
_F = np.float32
_MOST, _FAR = _F(30), _F(60)

Params = dict[str, np.ndarray]


class Classes:
    """Ids by class: members of a class stand together in `order`, class c from begin[c] to begin[c + 1]."""

    def __init__(self, counts: np.ndarray, n: int = CLASSES) -> None:
        n = min(n, len(counts))
        by_count = np.argsort(-counts, kind="stable")
        weight = np.sqrt(counts[by_count] + 0.1)
        share = np.cumsum(weight) / weight.sum()
        own = np.minimum((share * n).astype(np.int64), n - 1)
        own = np.unique(own, return_inverse=True)[1]
        self.order = by_count.astype(np.int32)
        self.begin = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own)).astype(np.int64)
        self.n = len(self.begin) - 1
        self.of = np.empty(len(counts), np.int16)
        self.of[by_count] = own
        self.place = np.empty(len(counts), np.int32)
        self.place[by_count] = np.arange(len(counts)) - self.begin[own]


def start(counts: np.ndarray, classes: Classes, seed: int = 3, width: int = WIDTH) -> Params:
    """Parameters before training: the unigram distribution of the counts, whatever the context. counts: of each id, the end id last."""
    rng = np.random.default_rng(seed)
    smooth = counts + 0.1
    by = np.bincount(classes.of, weights=smooth, minlength=classes.n)
    small = lambda *shape: (rng.standard_normal(shape) * 0.4).astype(_F)
    return {
        "e": small(len(counts), width), "q": small(width, width) / 2, "k": small(width, width) / 2, "v": small(width, width), "s": np.eye(width, dtype=_F), "r": np.zeros(WINDOW, _F),
        "c": np.zeros((width, classes.n), _F), "cb": np.log(by / by.sum()).astype(_F),
        "o": np.zeros((len(counts), width), _F), "ob": np.log(smooth[classes.order] / by[classes.of[classes.order]]).astype(_F),
    }


_BACK = (np.arange(STRIDE)[:, None] + STRIDE - np.arange(WINDOW)[None]).clip(0)  # how far back a key lies
_SEEN = (np.arange(WINDOW)[None] <= np.arange(STRIDE)[:, None] + STRIDE).astype(_F)


def blocks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For streams of n targets in a row: (stream, first target, number of targets) of each block."""
    many = -(-n // STRIDE)
    own = np.repeat(np.arange(len(n)), many)
    at = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return own, at, np.minimum(STRIDE, n[own] - at)


# A float32's bits as an integer are about linear in the logarithm of what it stands for.
_PER_E, _ONE = _F(2**23 / np.log(2)), _F(127 * 2**23 - 366_000)


def _exp(x: np.ndarray) -> np.ndarray:
    """About exp(x), within 3 %, from the bits of a float32; overwrites x, which has to lie in -80 to 80. Whatever is normalised by sums
    of it is a distribution all the same."""
    x *= _PER_E
    x += _ONE
    return x.astype(np.int32).view(_F)


class Scorer:
    """log probabilities under fixed parameters. What depends on one id alone is worked out once for each id."""

    def __init__(self, p: Params, classes: Classes) -> None:
        self.classes, self.d = classes, p["q"].shape[0]
        self.end = len(p["e"]) - 1
        self.query = (p["e"] @ p["q"] / _F(np.sqrt(self.d))).astype(_F)
        self.key, self.value, self.skip = ((p["e"] @ p[m]).astype(_F) for m in "kvs")
        self.value = np.concatenate([self.value, np.ones((len(self.value), 1), _F)], 1)
        self.near = (np.exp(p["r"][_BACK]) * _SEEN).astype(_F)
        self.c, self.cb = p["c"], p["cb"]
        self.o = [np.ascontiguousarray(p["o"][a:b].T) for a, b in zip(classes.begin, classes.begin[1:])]
        self.ob = [p["ob"][a:b] for a, b in zip(classes.begin, classes.begin[1:])]

    def hidden(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Vectors (blocks * STRIDE, width) for inputs x (blocks, STRIDE); each block follows the one before it unless first."""
        m, d = len(x), self.d
        pad = np.concatenate([x[:1], x]).reshape(-1)  # in front of all, something that no block sees
        k, v = self.key.take(pad, 0).reshape(m + 1, STRIDE, d), self.value.take(pad, 0).reshape(m + 1, STRIDE, d + 1)
        both = lambda t: np.lib.stride_tricks.as_strided(t, (m, WINDOW, t.shape[2]), t.strides)
        a = self.query.take(x, 0) @ both(k).transpose(0, 2, 1)
        np.clip(a, -_MOST, _MOST, out=a)
        a = _exp(a)
        a *= self.near
        a[first, :, :STRIDE] = 0
        z = (a @ both(v)).reshape(-1, d + 1)
        out = z[:, :d] / z[:, d:]
        out += self.skip.take(x.reshape(-1), 0)
        return out

    def targets(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log probability of each target y given its vector z."""
        c = self.classes.of.take(y)
        order = np.argsort(c, kind="stable")
        z, c, place = z.take(order, 0), c.take(order), self.classes.place.take(y).take(order)
        out = np.empty(len(y), _F)
        for a in range(0, len(y), 4096):
            out[a : a + 4096] = _share(z[a : a + 4096] @ self.c, self.cb, c[a : a + 4096])
        cuts = np.searchsorted(c, np.arange(self.classes.n + 1))
        for j, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if b > a and len(self.ob[j]) > 1:
                out[a:b] *= _share(z[a:b] @ self.o[j], self.ob[j], place[a:b])
        back = np.empty(len(y), _F)
        back[order] = np.log(out)
        return back

    def log_probabilities(self, flat: np.ndarray, n: np.ndarray, at_once: int = 256, together: int = 8) -> np.ndarray:
        """Natural log probabilities of streams of n targets each, all in a row in flat: a sum for each stream. Windows are read at_once
        blocks at a time, and the vectors of `together` such batches meet the classes at once."""
        out = np.zeros(len(n))
        own, at, size = blocks(n)
        starts = np.cumsum(n) - n
        begin = starts[own] + at
        before = np.roll(flat, 1)
        before[starts[n > 0]] = self.end
        span = np.arange(STRIDE)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(own), at_once):
            lead = int(at[low] > 0)  # the block before the first one is there again as context
            rows = slice(low - lead, min(low + at_once, len(own)))
            where = np.minimum(begin[rows, None] + span, len(flat) - 1)
            z = self.hidden(before.take(where), at[rows] == 0)
            inside = span < size[rows, None]
            inside[:lead] = False
            inside = np.flatnonzero(inside.reshape(-1))
            held.append((z.take(inside, 0), flat.take(where.reshape(-1).take(inside)), own[rows].take(inside // STRIDE)))
            if len(held) == together or low + at_once >= len(own):
                z, y, whose = (np.concatenate(part) for part in zip(*held))
                out += np.bincount(whose, weights=self.targets(z, y), minlength=len(n))
                held = []
        return out


def _share(logits: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The share of one entry of each row; overwrites logits. Rows hold at most some thousand entries."""
    logits += bias
    np.clip(logits, -_FAR, _FAR, out=logits)
    e = _exp(logits)
    return e[np.arange(len(e)), which] / (e @ np.ones(e.shape[1], _F))


def _off(logits: np.ndarray, many: np.ndarray, which: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How far the softmax of each row is off one entry of each, and that entry's share; overwrites logits. The softmax is exact but for
    logits beyond the bounds that the scorer holds them to as well. many: 0, 1, 2 and so on."""
    np.minimum(logits, _FAR, out=logits)
    np.maximum(logits, -_FAR, out=logits)
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
    at = many[: len(logits)] * logits.shape[1] + which
    flat = logits.reshape(-1)
    share[:] = flat.take(at)
    flat[at] -= 1
    return logits


class _Read:
    """Vectors of some blocks' targets under parameters, and the gradients from what the vectors are told. See gradients for the arguments.
    A block that follows the one before it shares its inputs, so that each input is read and told its gradient once."""

    def __init__(self, e: np.ndarray, matrices: np.ndarray, near: np.ndarray, x: np.ndarray, first: np.ndarray, inside: np.ndarray) -> None:
        # Units of STRIDE inputs in a row: one that no block sees, the blocks' own, and before a block whose context is not there its context.
        follows = np.zeros(len(x), bool)
        follows[1:] = (x[1:, :STRIDE] == x[:-1, STRIDE:]).all(1)
        lead = np.flatnonzero(~first & ~follows)
        own = np.arange(len(x)) + np.searchsorted(lead, np.arange(len(x)), "right")
        self.m, self.d, self.matrices = len(x) + len(lead), matrices.shape[0], matrices
        unit, alone = np.empty((self.m + 1, STRIDE), np.int64), np.ones(self.m, bool)
        unit[0], unit[own + 1], unit[own[lead]] = x[0, STRIDE:], x[:, STRIDE:], x[lead, :STRIDE]
        alone[own] = first
        self.unit, self.at = unit.reshape(-1), (own[:, None] * STRIDE + np.arange(STRIDE))[inside]

        m, d, dtype = self.m, self.d, matrices.dtype
        self.e = e.take(self.unit, 0)
        told = self.e @ matrices
        self.q, skip = (told[STRIDE:, c : c + d].reshape(m, STRIDE, d) for c in (0, 3 * d))
        row = told.strides[0]
        self.k, self.v = (np.lib.stride_tricks.as_strided(told[:, c:], (m, WINDOW, d), (STRIDE * row, row, told.itemsize)) for c in (d, 2 * d))
        a = self.q @ self.k.transpose(0, 2, 1)
        self.low = a < _MOST if a.max() >= _MOST else None
        if self.low is not None:
            np.minimum(a, _MOST, out=a)
        np.exp(a, out=a)
        a *= near
        a[alone, :, :STRIDE] = 0
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype)).reshape(m, STRIDE, 1)
        self.a, self.mixed = a, a @ self.v
        skip += self.mixed
        self.z = skip.reshape(-1, d) if len(self.at) == m * STRIDE else skip.reshape(-1, d).take(self.at, 0)

    def back(self, dz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the four matrices side by side, of r, and of the vector of each input in unit."""
        m, d, dtype = self.m, self.d, dz.dtype
        if len(dz) == m * STRIDE:
            dout = dz.reshape(m, STRIDE, d)
        else:
            dout = np.zeros((m * STRIDE, d), dtype)
            dout[self.at] = dz
            dout = dout.reshape(m, STRIDE, d)
        draw = dout @ self.v.transpose(0, 2, 1)
        draw -= np.einsum("bij,bij->bi", dout, self.mixed)[..., None]
        draw *= self.a
        r = np.bincount(_BACK.reshape(-1), weights=np.ones(m, dtype) @ draw.reshape(m, -1), minlength=WINDOW)
        if self.low is not None:
            draw *= self.low
        # What a unit's inputs are told as keys and values comes from its own block and from the next one.
        told = np.empty((m + 1, STRIDE, 4, d), dtype)
        told[0], told[1:, :, 3] = 0, dout
        np.matmul(draw, self.k, out=told[1:, :, 0])
        for c, of, by in ((1, draw, self.q), (2, self.a, dout)):
            np.matmul(of[:, :, STRIDE:].transpose(0, 2, 1), by, out=told[1:, :, c])
            told[:-1, :, c] += of[:, :, :STRIDE].transpose(0, 2, 1) @ by
        told = told.reshape(-1, 4 * d)
        return self.e.T @ told, r, told @ self.matrices.T


def gradients(p: Params, classes: Classes, x: np.ndarray, y: np.ndarray, first: np.ndarray, inside: np.ndarray, at_once: int = 128) -> tuple[float, Params, tuple[np.ndarray, np.ndarray]]:
    """Mean loss over the targets, its gradients, and which rows of e and o they touch (the gradients of e and o hold those rows alone).
    x: inputs (blocks, WINDOW); y, inside: targets (blocks, STRIDE) and which of them count; first: blocks whose first half is no context.
    Windows are read at_once blocks at a time, which stay near the processor."""
    d, dtype = p["q"].shape[0], p["q"].dtype
    scale = dtype.type(1 / np.sqrt(d))
    matrices = np.concatenate([p["q"] * scale, p["k"], p["v"], p["s"]], 1)
    near = np.exp(p["r"][_BACK]) * _SEEN
    reads = [_Read(p["e"], matrices, near, *(t[b : b + at_once] for t in (x, first, inside))) for b in range(0, len(x), at_once)]
    t = y[inside]
    n, own = len(t), classes.of.take(t)
    order = np.argsort(own, kind="stable")
    z = np.ones((n, d + 1), dtype)  # with a 1 for the bias
    z[:, :d] = np.concatenate([read.z for read in reads]).take(order, 0)
    own, place = own.take(order), classes.place.take(t).take(order)

    dz, shares = np.empty((n, d), dtype), np.ones((2, n), dtype)
    many = np.arange(4096)
    c, by_c = np.concatenate([p["c"], p["cb"][None]]), np.zeros((d + 1, classes.n), dtype)
    back = np.ascontiguousarray(p["c"].T)
    for b in range(0, n, 2048):
        part = slice(b, b + 2048)
        off = _off(z[part] @ c, many, own[part], shares[0, part])
        by_c += z[part].T @ off
        np.matmul(off, back, out=dz[part])
    cuts = np.searchsorted(own, np.arange(classes.n + 1)).tolist()
    rows_o, by_o = [np.zeros(0, np.int64)], [np.zeros((0, d + 1), dtype)]
    for j, (low, high) in enumerate(zip(classes.begin.tolist(), classes.begin[1:].tolist())):
        if cuts[j] == cuts[j + 1] or high - low < 2:
            continue
        w = np.empty((high - low, d + 1), dtype)
        w[:, :d], w[:, d] = p["o"][low:high], p["ob"][low:high]
        sums, some = 0, min(4096, max(64, 200_000 // len(w)))  # logits that stay near the processor
        for b in range(cuts[j], cuts[j + 1], some):
            part = slice(b, min(b + some, cuts[j + 1]))
            off = _off(z[part] @ w.T, many, place[part], shares[1, part])
            sums += off.T @ z[part]
            dz[part] += off @ w[:, :d]
        rows_o.append(np.arange(low, high))
        by_o.append(sums)
    by_o, by_c = np.concatenate(by_o) / n, by_c / n
    g: Params = {"c": by_c[:d], "cb": by_c[d], "o": by_o[:, :d], "ob": by_o[:, d]}
    loss = -np.log(shares + 1e-30).sum()

    told = np.empty_like(dz)
    dz /= n
    told[order] = dz
    cuts = np.cumsum([len(read.z) for read in reads])[:-1]
    by_matrix, by_r, by_input = zip(*(read.back(part) for read, part in zip(reads, np.split(told, cuts))))
    by_matrix = sum(by_matrix)
    by_matrix[:, :d] *= scale
    g |= {name: np.ascontiguousarray(by_matrix[:, c * d : (c + 1) * d]) for c, name in enumerate("qkvs")}
    g["r"] = sum(by_r).astype(dtype)
    # Sums by id.
    unit = np.concatenate([read.unit for read in reads])
    found = np.zeros(len(p["e"]), bool)
    found[unit] = True
    rows_e = np.flatnonzero(found)
    number = np.empty(len(found), np.int64)
    number[rows_e] = np.arange(len(rows_e))
    cells = (number.take(unit) * d)[:, None] + np.arange(d)
    g["e"] = np.bincount(cells.reshape(-1), weights=np.concatenate(by_input).reshape(-1), minlength=len(rows_e) * d).reshape(-1, d).astype(dtype)
    return float(loss) / n, g, (rows_e, np.concatenate(rows_o))


class Trainer:
    """Adagrad from given parameters, over blocks with their windows as they come."""

    def __init__(self, p: Params, classes: Classes, rate: float, at_once: int = 512) -> None:
        self.p, self.classes, self.rate, self.at_once = {k: v.copy() for k, v in p.items()}, classes, rate, at_once
        self.seen = {k: np.full(v.shape, 1e-8, _F) for k, v in p.items()}
        self.held: list[tuple] = []
        self.count, self.loss, self.targets = 0, 0.0, 0

    def add(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, inside: np.ndarray) -> None:
        self.held.append((x, y, first, inside))
        self.count += len(x)
        if self.count >= self.at_once:
            self.step()

    def step(self) -> None:
        """One update over all blocks that are held."""
        if not self.count:
            return
        x, y, first, inside = (np.concatenate(part) for part in zip(*self.held))
        self.held, self.count = [], 0
        loss, g, (rows_e, rows_o) = gradients(self.p, self.classes, x, y, first, inside)
        self.loss += loss * inside.sum()
        self.targets += int(inside.sum())
        for name, v in g.items():
            rows = rows_e if name == "e" else rows_o if name in ("o", "ob") else slice(None)
            seen = self.seen[name][rows] + v * v
            self.seen[name][rows] = seen
            self.p[name][rows] -= self.rate * v / np.sqrt(seen)


def windows_of(flat: np.ndarray, n: np.ndarray, end: int, chosen: np.ndarray, every: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, first, inside (see gradients) of the chosen blocks (numbers among blocks(n), which is `every` if known) of streams in a row."""
    own, at, size = (t[chosen] for t in every or blocks(n))
    low = (np.cumsum(n) - n)[own]
    begin = low + at
    span = np.arange(STRIDE)
    where = begin[:, None] + span
    inside = span < size[:, None]
    y = flat[np.minimum(where, len(flat) - 1)]
    back = begin[:, None] + np.arange(-STRIDE, STRIDE) - 1
    x = np.where(back < low[:, None], end, flat[back.clip(0, len(flat) - 1)])
    return x, y, at == 0, inside
