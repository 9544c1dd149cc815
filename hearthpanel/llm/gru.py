"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax."""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 24
CLASS = 32  # words of a class
WINDOW = 32  # steps that a gradient goes back
BATCH = 32  # lanes of documents that train side by side, at least where there are so many documents, and at most
LANES = 256
SIDE = 1024  # documents that are scored side by side
ROWS = 8192  # words whose softmax is taken at a time
SPAN = 16_384  # parameters that take a step at a time
RATE = 0.01


class Gru:
    """Words 0 to ``size`` - 1 in classes of CLASS neighbours; id ``size`` stands for all other words, a class of its own."""

    def __init__(self, counts: np.ndarray, other: float, seed: int = 5):
        """Starts as the unigram model of ``counts``: hidden states count for nothing until trained."""
        random = np.random.default_rng(seed)
        self.size = len(counts)
        self.classes = -(-self.size // CLASS)
        padded = np.full(self.classes * CLASS, 1e-30)
        padded[: self.size] = counts + 0.5
        mass = padded.reshape(-1, CLASS).sum(1)
        self.parameters = {
            "inputs": random.normal(0, 0.3, (self.size + 1, 3 * HIDDEN)),
            "turn": random.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)),
            "to_class": np.zeros((HIDDEN, self.classes + 1)),
            "class_bias": np.log(np.append(mass, other + 0.5) / (mass.sum() + other + 0.5)),
            "to_word": np.zeros((self.classes, CLASS, HIDDEN)),
            "word_bias": np.log(padded.reshape(-1, CLASS) / mass[:, None]),
        }
        self.parameters = {k: v.astype(np.float32) for k, v in self.parameters.items()}
        self.made, self.moments, self.kept = 0, None, {}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parameters.values()])

    def _named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of ``flat`` in the parameters' shapes, not copied."""
        parts, at = {}, 0
        for name, value in self.parameters.items():
            parts[name] = flat[at : at + value.size].reshape(value.shape)
            at += value.size
        return parts

    def load(self, flat: np.ndarray) -> Gru:
        self.parameters = self._named(flat.astype(np.float32))
        self.made, self.moments = 0, None
        return self

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next call for ``name`` gets again: fresh large ones cost more, in pages, than the sums in them."""
        size, dtype = math.prod(shape), self.parameters["turn"].dtype
        if name not in self.kept or self.kept[name].size < size or self.kept[name].dtype != dtype:
            self.kept[name] = np.empty(size, dtype)
        return self.kept[name][:size].reshape(shape)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of inputs and states with one block for each gate and the fresh state, so that a step's arrays have no gaps.

        They are negated, as sigmoids take them, those of the fresh state twice over: tanh(x) is 2 sigmoid(2 x) - 1.
        """
        sign = np.array([-1, -1, -2], self.parameters["turn"].dtype).reshape(3, 1, 1)
        weights = [np.moveaxis(self.parameters[k].reshape(-1, 3, HIDDEN), 1, 0) for k in ("inputs", "turn")]
        return tuple(np.multiply(x, sign, out=self._space(k, *x.shape)) for k, x in zip(("inputs", "turn"), weights))

    def step(
        self,
        state: np.ndarray,
        word: np.ndarray,
        blocks: tuple[np.ndarray, np.ndarray] | None = None,
        into: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    ) -> tuple[np.ndarray, ...]:
        """The state after ``word``; then both gates, the fresh state, the old state less it, and -2 times what the reset gate is applied to.

        They fill ``into``: three blocks, three blocks and the new state.
        """
        inputs, turn = blocks or self.blocks()
        given, turned, after = into or (np.empty((3, *state.shape), turn.dtype), np.empty((3, *state.shape), turn.dtype), np.empty(state.shape, turn.dtype))
        np.take(inputs, word, axis=1, out=given, mode="clip")  # every id has its row; other modes copy
        np.matmul(state, turn, out=turned)
        gates = given[:2]
        gates += turned[:2]
        np.exp(gates, out=gates)  # where this overflows a gate is 0
        gates += 1
        np.reciprocal(gates, out=gates)
        (keep, reset, fresh), (change, passed, before_reset) = given, turned
        np.multiply(reset, before_reset, out=passed)
        fresh += passed
        np.exp(fresh, out=fresh)
        fresh += 1
        np.divide(2, fresh, out=fresh)
        fresh -= 1
        np.subtract(state, fresh, out=change)
        np.multiply(keep, change, out=after)
        after += fresh
        return after, keep, reset, fresh, change, before_reset

    def _softmax(self, logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """In place, of every column; ``weights`` (..., choices, hidden) and ``bias`` (..., choices) made them of states within -1 and 1."""
        reach = np.abs(weights).sum(-1)
        if not (bias + reach).max() < 40 or (bias - reach).max(-1).min() < -40:  # its exponential may leave the range of floats
            logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def outputs(self, states: np.ndarray, words: np.ndarray, slopes: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word after its state; with ``slopes``, adds to them and returns the slope of the states.

        The probability is that of the class times that of the word within it;
        other words get the probability of their class alone. The slope of the
        states lasts until the next call.
        """
        logs = np.empty(len(words), self.parameters["turn"].dtype)
        back = None if slopes is None else self._space("back", len(words), HIDDEN)
        for a in range(0, len(words), ROWS):
            part = slice(a, a + ROWS)
            self._outputs(states[part], words[part], logs[part], slopes, None if back is None else back[part])
        return logs, back

    def _outputs(self, states: np.ndarray, words: np.ndarray, logs: np.ndarray, slopes: dict[str, np.ndarray] | None, back: np.ndarray | None) -> None:
        p = self.parameters
        group = (words // CLASS).astype(np.min_scalar_type(self.classes))
        group[words == self.size] = self.classes
        chance = np.matmul(p["to_class"].T, states.T, out=self._space("class", self.classes + 1, len(words)))
        chance += p["class_bias"][:, None]
        self._softmax(chance, p["to_class"].T, p["class_bias"])
        at = np.arange(len(words))
        right = chance[group, at]
        np.log(right + 1e-30, out=logs)
        if back is not None:
            chance[group, at] = right - 1
            slopes["to_class"] += (chance @ states).T
            slopes["class_bias"] += chance.sum(1)
            np.matmul(chance.T, p["to_class"].T, out=back)
        order = np.argsort(group, kind="stable")  # short whole numbers: a radix sort
        cuts = np.searchsorted(group[order], np.arange(self.classes + 1)).tolist()
        order = order[: cuts[-1]]
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        mine = np.take(states, order, axis=0, out=self._space("mine", len(order), HIDDEN), mode="clip")
        inside, at = words[order] % CLASS, np.arange(len(order))
        chance = self._space("word", CLASS, len(order))
        for c, span in spans:
            np.matmul(p["to_word"][c], mine[span].T, out=chance[:, span])
            chance[:, span] += p["word_bias"][c][:, None]
        self._softmax(chance, p["to_word"], p["word_bias"])
        right = chance[inside, at]
        logs[order] += np.log(right + 1e-30)
        if back is not None:
            chance[inside, at] = right - 1
            told = self._space("told", len(order), HIDDEN)
            for c, span in spans:
                slopes["to_word"][c] += chance[:, span] @ mine[span]
                slopes["word_bias"][c] += chance[:, span].sum(1)
                np.matmul(chance[:, span].T, p["to_word"][c], out=told[span])
            told += np.take(back, order, axis=0, out=mine, mode="clip")
            back[order] = told

    @np.errstate(over="ignore")
    def slopes(
        self, state: np.ndarray, seen: np.ndarray, words: np.ndarray, mask: np.ndarray, begins: np.ndarray | None = None
    ) -> tuple[np.ndarray, dict[str, np.ndarray], float]:
        """One window of (documents, steps): the state after it, the slopes of the loss per word, the summed log probability.

        Where ``begins`` is set another document begins, with an empty state.
        """
        flat = np.zeros_like(self.flat())
        state, total = self._add_slopes(self._named(flat), state, seen, words, mask, begins)
        flat /= max(1, int(mask.sum()))
        return state, self._named(flat), total

    def _add_slopes(
        self, slopes: dict[str, np.ndarray], state: np.ndarray, seen: np.ndarray, words: np.ndarray, mask: np.ndarray, begins: np.ndarray | None
    ) -> tuple[np.ndarray, float]:
        """Adds the slopes of a window's summed loss; the state after it and the summed log probability."""
        lanes, steps = words.shape
        seen, words, mask = (np.ascontiguousarray(x.T) for x in (seen, words, mask))  # a step's words in a row
        goes_on = np.ones((steps, lanes, 1), bool) if begins is None else ~begins.T[:, :, None]
        full, same = mask.all(1), goes_on.all((1, 2))
        blocks = self.blocks()
        before, after = self._space("before", steps, lanes, HIDDEN), self._space("after", steps, lanes, HIDDEN)
        first, second = self._space("first", steps, 3, lanes, HIDDEN), self._space("second", steps, 3, lanes, HIDDEN)
        trace = []
        for t in range(steps):
            np.multiply(state, goes_on[t], out=before[t]) if not same[t] else np.copyto(before[t], state)
            state, *parts = self.step(before[t], seen[t], blocks, (first[t], second[t], after[t]))
            if not full[t]:
                np.copyto(state, before[t], where=~mask[t, :, None])
            trace.append(parts)
        state = state.copy()
        if full.all():
            logs, whole = self.outputs(after.reshape(-1, HIDDEN), words.ravel(), slopes)
            whole = whole.reshape(after.shape)
        else:
            whole = np.zeros_like(after)
            logs, whole[mask] = self.outputs(after[mask], words[mask], slopes)
        back = np.ascontiguousarray(self.parameters["turn"].T)
        turned, given = self._space("turned", steps, lanes, 3 * HIDDEN), self._space("given", steps, lanes, HIDDEN)
        carry, kept, moved, product = self._space("steps", 4, lanes, HIDDEN)
        carry[:] = 0
        for t in range(steps - 1, -1, -1):
            keep, reset, fresh, change, before_reset = trace[t]
            carry += whole[t]
            live = carry if full[t] else carry * mask[t, :, None]
            np.multiply(live, keep, out=kept)
            np.subtract(live, kept, out=moved)
            np.multiply(fresh, fresh, out=fresh)
            np.subtract(1, fresh, out=fresh)
            np.multiply(fresh, moved, out=given[t])
            moved *= keep
            np.multiply(moved, change, out=turned[t, :, :HIDDEN])
            np.multiply(given[t], reset, out=moved)
            turned[t, :, 2 * HIDDEN :] = moved
            reset -= 1
            reset *= before_reset
            reset *= 0.5
            np.multiply(reset, moved, out=turned[t, :, HIDDEN : 2 * HIDDEN])
            if not full[t]:
                kept += carry - live
            kept += np.matmul(turned[t], back, out=product)
            if not same[t]:
                kept *= goes_on[t]
            carry, kept = kept, carry
        turned, given = turned.reshape(-1, 3 * HIDDEN), given.reshape(-1, HIDDEN)
        slopes["turn"] += before.reshape(-1, HIDDEN).T @ turned
        self._add_by_word(slopes["inputs"], seen.ravel(), turned, given)
        return state, float(logs.sum())

    def _add_by_word(self, sums: np.ndarray, word: np.ndarray, turned: np.ndarray, given: np.ndarray) -> None:
        """Adds every row, that of ``turned`` with ``given`` as its last block, to the row of its word.

        Words of a class are added at once, by a product with their places in it.
        """
        other = (word == self.size).astype(sums.dtype)
        sums[self.size, : 2 * HIDDEN] += other @ turned[:, : 2 * HIDDEN]
        sums[self.size, 2 * HIDDEN :] += other @ given
        order = np.argsort(word.astype(np.min_scalar_type(self.size)), kind="stable")
        word = word[order]
        cuts = np.searchsorted(word, np.minimum(np.arange(self.classes + 1) * CLASS, self.size)).tolist()
        order, word = order[: cuts[-1]], word[: cuts[-1]]
        rows = np.take(turned, order, axis=0, out=self._space("rows", len(order), 3 * HIDDEN), mode="clip")
        rows[:, 2 * HIDDEN :] = np.take(given, order, axis=0, out=self._space("mine", len(order), HIDDEN), mode="clip")
        place = self._space("place", CLASS, len(order))
        place[:] = 0
        place[word % CLASS, np.arange(len(order))] = 1
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                into = sums[c * CLASS : min((c + 1) * CLASS, self.size)]
                into += place[: len(into), a:b] @ rows[a:b]

    @np.errstate(over="ignore")
    def train(self, documents: list[np.ndarray], start: int, rate: float = RATE) -> tuple[float, int]:
        """A pass of Adam over every word of whole documents: their summed log probability and number.

        Documents are dealt to lanes of about equal length, which run side by
        side in windows. A state is carried from window to window to the end of
        its document. The moments of Adam last until parameters are loaded.
        """
        flat = self.flat()
        self.parameters = self._named(flat)
        if self.moments is None:
            self.moments = np.zeros((2, len(flat)), flat.dtype)
        m, v = self.moments
        slope, change = np.empty((2, len(flat)), flat.dtype)
        slopes = self._named(slope)
        documents = sorted((d for d in documents if len(d)), key=len, reverse=True)
        if not documents:
            return 0.0, 0
        sizes = list(map(len, documents))
        lanes = min(len(sizes), LANES, max(BATCH, -(-sum(sizes) // sizes[0])))
        ends = [(0, i) for i in range(lanes)]
        places = []
        for size in sizes:  # the longest first, each to the shortest lane
            end, lane = heapq.heappop(ends)
            places.append((lane, end))
            heapq.heappush(ends, (end + size, lane))
        length = np.zeros(lanes, np.int64)
        for end, lane in ends:
            length[lane] = end
        falling = np.argsort(-length, kind="stable")
        rank = np.argsort(falling).tolist()
        length = length[falling]
        words = np.zeros((lanes, int(length[0])), documents[0].dtype)
        begins = np.zeros(words.shape, bool)
        for (lane, a), document in zip(places, documents):
            words[rank[lane], a : a + len(document)], begins[rank[lane], a] = document, True
        total = 0.0
        state = np.zeros((lanes, HIDDEN), np.float32)
        for a in range(0, words.shape[1], WINDOW):
            live = int(np.searchsorted(-length, -a, side="left"))
            cut = words[:live, a : a + WINDOW].astype(np.int64)
            before = words[:live, a - 1 : a] if a else np.full((live, 1), start)
            fresh = begins[:live, a : a + WINDOW]
            seen = np.where(fresh, start, np.concatenate([before, cut[:, :-1]], 1))
            mask = np.arange(a, a + cut.shape[1]) < length[:live, None]
            slope[:] = 0
            state, logs = self._add_slopes(slopes, state[:live], seen, cut, mask, fresh)
            total, self.made = total + logs, self.made + 1
            self._adam(flat, slope, m, v, change, rate, int(mask.sum()))
        return total, sum(sizes)

    def _adam(self, flat: np.ndarray, slope: np.ndarray, m: np.ndarray, v: np.ndarray, change: np.ndarray, rate: float, n: int) -> None:
        """A step by the slopes of ``n`` words, in spans that stay in a near cache."""
        far = math.sqrt(1 - 0.99**self.made)
        rate *= far / (1 - 0.9**self.made)
        for a in range(0, len(flat), SPAN):
            x, g, u, w, y = (z[a : a + SPAN] for z in (flat, slope, m, v, change))
            g *= 0.1 / n
            u *= 0.9
            u += g
            g *= g  # 0.01 of the square
            w *= 0.99
            w += g
            np.sqrt(w, out=y)
            y += 1e-6 * far
            np.divide(u, y, out=y)
            y *= rate
            x -= y

    @np.errstate(over="ignore")
    def score(self, words: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
        """Log probability of every whole document of ``words``, cut at ``bounds``; states are carried to a document's end."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        out, blocks = np.zeros(len(size)), self.blocks()
        for a in range(0, len(order), SIDE):  # neighbours in length move side by side
            mine = order[a : a + SIDE]
            out[mine] = self._score_side(words, bounds[mine], size[mine], start, blocks)
        return out

    def _score_side(self, words: np.ndarray, first: np.ndarray, size: np.ndarray, start: int, blocks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Scores of documents by falling size."""
        total = np.zeros(len(size))
        active = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()
        after = self._space("after", ROWS + len(size), HIDDEN)
        state, seen = np.zeros((len(size), HIDDEN), blocks[1].dtype), np.full(len(size), start)
        lanes, targets, filled, all_lanes = [], [], 0, np.arange(len(size))
        for t, n in enumerate(active):
            into = self._space("first", 3, n, HIDDEN), self._space("second", 3, n, HIDDEN), after[filled : filled + n]
            state = self.step(state[:n], seen[:n], blocks, into)[0]
            seen = words[first[:n] + t]
            targets.append(seen)
            lanes.append(all_lanes[:n])
            filled += n
            if filled >= ROWS or t + 1 == len(active):
                logs, _ = self.outputs(after[:filled], np.concatenate(targets))
                total += np.bincount(np.concatenate(lanes), logs, minlength=len(total))
                state, lanes, targets, filled = state.copy(), [], [], 0
        return total
