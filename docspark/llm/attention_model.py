"""A causal self-attention model over symbols, in numpy, with its gradients.

A sequence is scored in windows of `2 S` positions: the last S are queries,
the S before them are context only, so consecutive windows overlap by half and
every symbol is scored once, with S to 2 S - 1 symbols before it (fewer at the
start). Windows of many sequences form one batch; a mask hides later
positions, places before the start and padding.

One block: attention with a learned bias per distance, a rectified layer, and
logits on top of a fixed prior (log shares of symbol pairs). Symbols are
`groups * members` in number and predicted in two steps, the group and then
the member of the group, so a target costs their sum in exponentials instead
of their product. The output weights start at zero: an untrained model is the
prior itself.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16
WIDTH, HIDDEN, MEMBERS = 32, 32, 32
_CLIP = np.float32(20)
#: Sums of exponentials outside are taken again, relative to the largest.
_SMALL, _LARGE = 1e-20, 1e30
#: Rows of symbols that have no more are summed up together.
_FEW = 12


def windows(sequences: np.ndarray, sizes: np.ndarray, start: int, pad: int, stride: int = STRIDE):
    """(inputs, targets) of all windows of concatenated sequences.

    Each sequence begins with the input `start`; inputs are (w, 2 stride),
    targets (w, stride), both `pad` where there is nothing.
    """
    blocks = -(-sizes // stride)
    # One empty block before each sequence.
    first = np.cumsum(blocks + 1) - blocks
    place = np.arange(len(sequences)) + np.repeat(first * stride - (np.cumsum(sizes) - sizes), sizes)
    cells = int((blocks + 1).sum()) * stride
    target = np.full(cells, pad, dtype=np.intp)
    target[place] = sequences
    inputs = np.full(cells + 1, pad, dtype=np.intp)
    inputs[place + 1] = sequences
    begins = first[sizes > 0] * stride
    inputs[begins] = start
    inputs = inputs[:cells].reshape(-1, stride)
    # The input after a sequence's last target belongs to nothing.
    target = target.reshape(-1, stride)
    inputs[target == pad] = pad
    real = np.arange(int(blocks.sum())) + np.repeat(first - (np.cumsum(blocks) - blocks), blocks)
    return np.concatenate([inputs[real - 1], inputs[real]], axis=1), target[real]


def _log_shares(prior: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of groups, and of members within their group."""
    n = len(prior)
    shares = np.exp(prior.astype(np.float64)).reshape(n, -1, members)
    groups = shares.sum(axis=2)
    return (np.log(groups).astype(np.float32),
            np.ascontiguousarray(np.log(shares / groups[:, :, None]).astype(np.float32)))


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials up to a factor of their row, logarithms of the sums of
    rows, sums of rows up to that factor)."""
    ones = np.ones(logits.shape[1], dtype=np.float32)
    with np.errstate(over="ignore"):
        out = np.exp(logits)
    total = out @ ones
    if len(total) and not (total.min() > _SMALL and total.max() < _LARGE):
        top = logits.max(axis=1)
        np.exp(logits - top[:, None], out=out)
        total = out @ ones
        return out, top + np.log(total), total
    return out, np.log(total), total


class AttentionModel:
    """Parameters by name. Symbol `n` (one beyond the last) is padding.

    `prior` holds log probabilities, a row per symbol before, and has a
    multiple of `members` columns. Queries, keys and values depend on the
    symbol alone, so they are tables. The value of padding is zero, also in
    the column of ones that sums the attention weights: it has no share.
    """

    def __init__(self, prior: np.ndarray, members: int = MEMBERS, seed: int = 7, stride: int = STRIDE) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        n = len(prior)
        self.n, self.stride, self.members = n, stride, members
        self.prior = _log_shares(prior, members)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "embedding": normal(n, WIDTH, scale=.5),
            **{w: normal(WIDTH, WIDTH, scale=WIDTH ** -.5) for w in ("query", "key", "value", "mix")},
            "distance": np.zeros(2 * stride, dtype=np.float32),
            "up": normal(WIDTH, HIDDEN, scale=WIDTH ** -.5), "up_bias": np.zeros(HIDDEN, dtype=np.float32),
            "down": normal(HIDDEN, WIDTH, scale=HIDDEN ** -.5),
            "group": np.zeros((n // members, WIDTH), dtype=np.float32),
            "member": np.zeros((n, WIDTH), dtype=np.float32)}
        at = np.arange(stride)[:, None] + stride - np.arange(2 * stride)[None, :]
        self._past, self._distance = at >= 0, np.maximum(at, 0)

    # Parameters as one vector, for averaging.
    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for name, v in self.p.items():
            self.p[name] = vector[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def _tables(self) -> dict[str, np.ndarray]:
        """Projections of every symbol and of padding, side by side where they
        are looked up together. Values are mixed already."""
        p, n = self.p, self.n
        query, context = (np.empty((n + 1, k), dtype=np.float32) for k in (2 * WIDTH, 2 * WIDTH + 1))
        query[n] = context[n] = 0
        mixed = p["value"] @ p["mix"]
        query[:n, :WIDTH] = p["embedding"] @ (p["query"] * np.float32(WIDTH ** -.5))
        query[:n, WIDTH:] = p["embedding"]
        context[:n, :-1] = p["embedding"] @ np.concatenate([p["key"], mixed], axis=1)
        context[:n, -1] = 1
        # What bounds the products below, so that no exponential overflows.
        longest = [np.einsum("ij,ij->i", t[:, :WIDTH], t[:, :WIDTH]).max() for t in (query, context)]
        reach = np.sqrt(longest[0] * longest[1])
        if reach > _CLIP:
            query[:, :WIDTH] *= np.float32(_CLIP / reach)
        return {
            "query": query, "context": context, "mixed": mixed,
            "shrink": min(1.0, float(_CLIP / reach)) if reach else 1.0,
            # Shares of distances; a later position has none.
            "near": np.where(self._past, np.exp(p["distance"][self._distance]), np.float32(0))}

    def _members(self, name: np.ndarray, group: int) -> np.ndarray:
        return name[group * self.members:(group + 1) * self.members]

    def _forward(self, tables: dict, inputs: np.ndarray, targets: np.ndarray) -> dict:
        """Everything up to the logits of the real targets, sorted by group."""
        p = self.p
        asked = inputs[:, self.stride:].ravel()
        both = tables["query"].take(asked, axis=0)
        if "pairs" in tables:
            queries = keys = None
            values = tables["values"].take(inputs, axis=0)
            weight = tables["pairs"].take(inputs[:, self.stride:, None] * (self.n + 1) + inputs[:, None, :])
        else:
            queries = both[:, :WIDTH].reshape(len(inputs), self.stride, -1)
            context = tables["context"].take(inputs, axis=0)
            keys, values = context[:, :, :WIDTH], context[:, :, WIDTH:]
            weight = queries @ keys.transpose(0, 2, 1)
            np.exp(weight, out=weight)
        weight *= tables["near"]
        summed = (weight @ values).reshape(-1, WIDTH + 1)
        total = summed[:, WIDTH:] + np.float32(1e-30)
        attended = summed[:, :WIDTH] / total
        first = attended + both[:, WIDTH:]
        up = first @ p["up"]
        up += p["up_bias"]
        np.maximum(up, 0, out=up)
        last = up @ p["down"]
        last += first
        wanted = targets.ravel()
        n_groups = self.n // self.members
        group = (wanted // self.members).astype(np.int16)
        every = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group.take(every), np.arange(n_groups + 1)).tolist()
        order = every[:cuts[-1]]
        group, before = group.take(order).astype(np.intp), asked.take(order)
        last = last.take(order, axis=0)
        groups = last @ p["group"].T
        groups += self.prior[0].take(before, axis=0)
        members = np.empty((len(order), self.members), dtype=np.float32)
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                np.matmul(last[a:b], self._members(p["member"], g).T, out=members[a:b])
        members += self.prior[1].reshape(-1, self.members).take(before * n_groups + group, axis=0)
        return {"asked": asked, "keys": keys, "values": values, "queries": queries, "weight": weight, "total": total,
                "attended": attended, "first": first, "up": up, "last": last, "every": every, "order": order,
                "cuts": cuts, "steps": ((groups, group), (members, wanted.take(order) % self.members))}

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, batch: int = 256) -> np.ndarray:
        """Natural logarithm of the probability of every target; 0 for padding."""
        tables = self._tables()
        # The parameters stay, so weights are looked up by pair of symbols.
        context = tables["context"]
        tables["pairs"] = np.exp(tables["query"][:, :WIDTH] @ context[:, :WIDTH].T)
        tables["values"] = np.ascontiguousarray(context[:, WIDTH:])
        out = np.zeros(targets.shape, dtype=np.float64)
        for at in range(0, len(inputs), batch):
            f = self._forward(tables, inputs[at:at + batch], targets[at:at + batch])
            found = np.zeros(len(f["order"]))
            for logits, chosen in f["steps"]:
                places = np.arange(len(chosen)) * logits.shape[1] + chosen
                found += logits.ravel().take(places)
                found -= _exponentials(logits)[1]
            out[at:at + batch].reshape(-1)[f["order"]] = found
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of one batch, and its gradient."""
        tables, p = self._tables(), self.p
        f = self._forward(tables, inputs, targets)
        n, loss, steps = max(1, len(f["order"])), 0.0, []
        for logits, chosen in f["steps"]:
            places = np.arange(len(chosen)) * logits.shape[1] + chosen
            shares, logs, total = _exponentials(logits)
            loss += float((logs - logits.ravel().take(places)).sum()) / n
            shares *= (np.float32(1 / n) / total)[:, None]
            shares.reshape(-1)[places] -= np.float32(1 / n)
            steps.append(shares)
        d_group, d_member = steps
        g = {"group": d_group.T @ f["last"], "member": np.zeros_like(p["member"])}
        # By group, then zeros for padding.
        d_sorted = np.empty((targets.size, WIDTH), dtype=np.float32)
        d_sorted[len(d_group):] = 0
        for k, (a, b) in enumerate(zip(f["cuts"][:-1], f["cuts"][1:], strict=True)):
            if a < b:
                np.matmul(d_member[a:b].T, f["last"][a:b], out=self._members(g["member"], k))
                np.matmul(d_member[a:b], self._members(p["member"], k), out=d_sorted[a:b])
        d_sorted[:len(d_group)] += d_group @ p["group"]
        back = np.empty_like(f["every"])
        back[f["every"]] = np.arange(len(back))
        d_last = d_sorted.take(back, axis=0)
        g["down"] = f["up"].T @ d_last
        d_up = d_last @ p["down"].T
        d_up *= f["up"] > 0
        g["up"], g["up_bias"] = f["first"].T @ d_up, np.ones(len(d_up), dtype=np.float32) @ d_up
        shape = (len(inputs), self.stride, -1)
        # Sums by symbol of what reaches keys, values, queries and embeddings.
        rows = np.empty((*inputs.shape, 4 * WIDTH), dtype=np.float32)
        own = rows[:, self.stride:]
        rows[:, :self.stride, 2 * WIDTH:] = 0
        d_first = d_last
        d_first += d_up @ p["up"].T
        own[:, :, 3 * WIDTH:] = d_first.reshape(shape)
        # A weight's gradient is its value's product with what reaches the sum,
        # less the mean of such products, both over the weights' total.
        reached = np.empty((len(d_first), WIDTH + 1), dtype=np.float32)
        np.divide(d_first, f["total"], out=reached[:, :WIDTH])
        np.negative(np.einsum("ij,ij->i", reached[:, :WIDTH], f["attended"]), out=reached[:, WIDTH])
        reached = reached.reshape(shape)
        d_weight = reached @ f["values"].transpose(0, 2, 1)
        d_weight *= f["weight"]
        g["distance"] = np.bincount(self._distance.ravel(), d_weight.sum(axis=0).ravel(), 2 * self.stride)
        np.matmul(d_weight.transpose(0, 2, 1), f["queries"], out=rows[:, :, :WIDTH])
        np.matmul(f["weight"].transpose(0, 2, 1), reached[:, :, :WIDTH], out=rows[:, :, WIDTH:2 * WIDTH])
        np.matmul(d_weight, f["keys"], out=own[:, :, 2 * WIDTH:3 * WIDTH])
        sums = self._by_symbol(inputs, rows.reshape(-1, 4 * WIDTH))
        scale = np.float32(WIDTH ** -.5 * tables["shrink"])
        sums[:, 2 * WIDTH:3 * WIDTH] *= scale
        of_tables = sums[:, :3 * WIDTH]
        found = p["embedding"].T @ of_tables
        g["key"], d_mixed, g["query"] = found[:, :WIDTH], found[:, WIDTH:2 * WIDTH], found[:, 2 * WIDTH:]
        g["value"], g["mix"] = d_mixed @ p["mix"].T, p["value"].T @ d_mixed
        g["embedding"] = of_tables @ np.concatenate([p["key"], tables["mixed"], p["query"]], axis=1).T
        g["embedding"] += sums[:, 3 * WIDTH:]
        return loss, g

    def _by_symbol(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by symbol, without padding's."""
        symbols = symbols.ravel().astype(np.int16)
        order = np.argsort(symbols, kind="stable")
        rows, symbols = rows.take(order, axis=0), symbols.take(order)
        first = np.flatnonzero(np.diff(symbols, prepend=np.int16(-1)))
        sizes = np.diff(first, append=len(symbols))
        # Symbols of many rows first: a product each, the others together.
        turn = np.argsort(-sizes, kind="stable")
        first, sizes = first[turn], sizes[turn]
        sums = rows.take(first, axis=0)
        many = int(np.count_nonzero(sizes > _FEW))
        ones = np.ones(int(sizes[0]), dtype=np.float32)
        for k, (a, size) in enumerate(zip(first[:many].tolist(), sizes[:many].tolist(), strict=True)):
            np.matmul(ones[:size], rows[a:a + size], out=sums[k])
        for k in range(1, _FEW):
            end = max(many, int(np.count_nonzero(sizes > k)))
            sums[many:end] += rows.take(first[many:end] + k, axis=0)
        out = np.zeros((self.n + 1, rows.shape[1]), dtype=np.float32)
        out[symbols.take(first)] = sums
        return out[:self.n]

    def train(self, inputs: np.ndarray, targets: np.ndarray, rate: float = 1e-2, batch: int = 64, seed: int = 3) -> None:
        """One pass of Adam over the windows in a seeded order."""
        turn = np.random.Generator(np.random.PCG64(seed)).permutation(len(inputs))
        # One vector of all parameters; those by name are views of it.
        whole = np.concatenate([v.ravel() for v in self.p.values()])
        at = 0
        for name, v in self.p.items():
            self.p[name] = whole[at:at + v.size].reshape(v.shape)
            at += v.size
        # Sums of gradients and of their squares, weighted by .9 and .99 a step.
        mean, square, work = (np.zeros_like(whole) for _ in range(3))
        for step, at in enumerate(range(0, len(turn), batch), 1):
            rows = turn[at:at + batch]
            _, by_name = self.gradients(inputs[rows], targets[rows])
            g = np.concatenate([by_name[name].ravel() for name in self.p], dtype=np.float32)
            mean *= np.float32(.9)
            mean += g
            g *= g
            square *= np.float32(.99)
            square += g
            np.sqrt(square, out=work)
            # The squares' average is a hundredth of their sum, over `seen`.
            seen = (1 - .99 ** step) ** .5
            work += np.float32(1e-6 * 10 * seen)
            np.divide(mean, work, out=work)
            work *= np.float32(rate * seen / (1 - .9 ** step))
            whole -= work
