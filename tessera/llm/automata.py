"""Probabilistic automata inferred from strings by merging statistically compatible states of their prefix tree."""

from __future__ import annotations

import math
from collections import deque

END = ""


class Automaton:
    """counts[state][symbol] is how often the symbol was seen there (END: a string's end), steps[state][symbol] the next state."""

    def __init__(self, words: list[str], alpha: float = 0.05, alphabet: int = 11) -> None:
        self.counts: list[dict[str, int]] = [{}]
        self.steps: list[dict[str, int]] = [{}]
        for word in words:
            at = 0
            for symbol in word:
                self.counts[at][symbol] = self.counts[at].get(symbol, 0) + 1
                if symbol not in self.steps[at]:
                    self.steps[at][symbol] = len(self.steps)
                    self.counts.append({})
                    self.steps.append({})
                at = self.steps[at][symbol]
            self.counts[at][END] = self.counts[at].get(END, 0) + 1
        self._infer(math.sqrt(0.5 * math.log(2 / alpha)))
        self.size = max(alphabet, len({s for c in self.counts for s in c} - {END})) + 1

    def _alike(self, a: int, b: int, width: float) -> bool:
        """Hoeffding's bound holds for every symbol of two states and of the states reached from both."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.counts[a], self.counts[b]
            m, n = sum(p.values()), sum(q.values())
            if not m or not n:
                continue
            most = width * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if any(abs(p.get(s, 0) / m - q.get(s, 0) / n) > most for s in p.keys() | q.keys()):
                return False
            todo += [(self.steps[a][s], self.steps[b][s]) for s in self.steps[a].keys() & self.steps[b].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            for s, n in self.counts[b].items():
                self.counts[a][s] = self.counts[a].get(s, 0) + n
            for s, child in self.steps[b].items():
                if s in self.steps[a]:
                    todo.append((self.steps[a][s], child))
                else:
                    self.steps[a][s] = child

    def _infer(self, width: float) -> None:
        kept = [0]
        fringe = deque((0, s) for s in sorted(self.steps[0]))
        while fringe:
            parent, s = fringe.popleft()
            state = self.steps[parent][s]
            if state in kept:
                continue
            for one in kept:
                if self._alike(one, state, width):
                    before = {x: set(self.steps[x]) for x in kept}
                    self.steps[parent][s] = one
                    self._fold(one, state)
                    fringe.extend((x, y) for x in kept for y in sorted(set(self.steps[x]) - before[x]))
                    break
            else:
                kept.append(state)
                fringe.extend((state, y) for y in sorted(self.steps[state]))
        number = {state: i for i, state in enumerate(kept)}
        self.counts = [self.counts[x] for x in kept]
        self.steps = [{s: number[y] for s, y in self.steps[x].items()} for x in kept]

    def log_likelihood(self, word: str, smoothing: float = 0.5, ended: bool = True) -> float:
        """Of the word and its end, divided by its symbols and the end; where no step is known the word starts anew.

        With `ended` unset the end counts in neither.
        Counts are smoothed over the alphabet, so that an automaton of no words holds all symbols equally likely.
        """
        total, at = 0.0, 0
        for symbol in (*word, END) if ended else word:
            seen = self.counts[at]
            total += math.log((seen.get(symbol, 0) + smoothing) / (sum(seen.values()) + smoothing * self.size))
            at = self.steps[at].get(symbol, 0)
        return total / (len(word) + ended)
