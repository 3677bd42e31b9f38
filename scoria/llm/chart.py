"""Error-correcting chart parsing of token classes by small grammars.

A grammar is text: one rule a line, `Name: alternative | alternative`; a symbol may end in `?`, `*` or `+`. Names of rules
are nonterminals, everything else is a token class. A token that stands for a whole bracket has the class (kind,
labels): the kind's letter and the nonterminals that its contents match; `P:Args` matches a P whose labels hold Args. A word that is a keyword only in some places has the class ~word and matches i too; i also matches q, a name with dots, which n doesn't.
"""

from __future__ import annotations

from functools import cache

import numpy as np

class Grammar:
    def __init__(self, text: str):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        heads = [line.partition(":")[0].strip() for line in text.strip().splitlines() if line.strip()]
        self.by: dict[str, list[int]] = {h: [] for h in heads}
        for line in text.strip().splitlines():
            head, _, body = line.partition(":")
            for alternative in body.split(" | ") if line.strip() else []:
                self._add(head.strip(), [self._expand(s) for s in alternative.split()])
        self.recognized: dict = {}
        self.costs: dict = {}
        self.dotted: tuple | None = None
        self.bounds: dict[str, Bounds] = {}
        self.fitted: dict = {}
        self.looking: dict = {}
        self.looks: dict = {}
        self._find_nullable()

    def sequence(self, item: str) -> str:
        """The nonterminal for any number of items."""
        name = self._expand(item + "*")
        self._find_nullable()
        self.dotted = None
        return name

    def _find_nullable(self) -> None:
        self.nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for head, body in self.rules:
                if head not in self.nullable and all(s in self.nullable for s in body):
                    self.nullable.add(head)
                    grown = True

    def _add(self, head: str, body: list[str]) -> None:
        self.by.setdefault(head, []).append(len(self.rules))
        self.rules.append((head, tuple(body)))

    def _expand(self, s: str) -> str:
        if len(s) < 2 or s[-1] not in "?*+" or not (s[-1] == "?" or s[-2].isalnum()):
            return s
        if s not in self.by:
            one, more = s[:-1], self._expand(s[:-1] + "*") if s[-1] == "+" else s
            self.by[s] = []
            self._add(s, [] if s[-1] != "+" else [one, more])
            if s[-1] != "+":
                self._add(s, [one] if s[-1] == "?" else [s, one])
        return s

    @staticmethod
    @cache
    def fits(terminal: str, token) -> bool:
        if isinstance(token, str):
            if token == "q":
                return terminal == "i"
            return terminal == token or terminal == "n" and (token == "i" or token[0] == "~" and len(token) > 1) or token[0] == "~" and len(token) > 1 and (terminal == "i" or terminal == token[1:])
        kind, labels = token
        return terminal == kind or terminal[0] == kind and terminal[1:2] == ":" and terminal[2:] in labels

    def possible(self, start: str, tokens: tuple) -> bool:
        """Whether the tokens hold all token classes that one of start's rules names, which matching needs and is quick to tell."""
        distinct = set(tokens)
        return any(all(s in self.by or any(self.fits(s, t) for t in distinct) for s in self.rules[r][1]) for r in self.by[start])

    def can_begin(self, start: str, tokens: tuple) -> bool:
        """Whether a rule of start can begin with the first token, which matching needs and is quick to tell."""
        self._states()
        return bool(self._looking(tokens[0] if tokens else None)[2][start])

    def matches(self, start: str, tokens: tuple) -> bool:
        """Whether the tokens derive from start without any edit."""
        key = (start, tokens)
        if key not in self.recognized:
            if len(self.recognized) > 200_000:
                self.recognized.clear()
            self.recognized[key] = self._earley(start, tokens)
        return self.recognized[key]

    def _earley(self, start: str, tokens: tuple) -> bool:
        """Items are dotted rules with where they began; those whose rest can neither begin with the next token nor be empty are left out."""
        predicted, symbols, heads, onward = self._states()
        nullable, n = self.nullable, len(tokens)
        bits = (n + 1).bit_length()
        low = (1 << bits) - 1
        fitting, live, coming = self._looking(tokens[0] if tokens else None)
        column = {q << bits: None for q in coming[start]}
        waiting: list[dict[str, list[int]]] = []
        for i in range(n + 1):
            if not column:
                return False
            wait: dict[str, list[int]] = {}
            waiting.append(wait)
            agenda, following = list(column), {}
            fitting_next, live_next, coming_next = self._looking(tokens[i + 1] if i + 1 < n else None)
            for item in agenda:
                state = item >> bits
                s = symbols[state]
                if s is None:
                    for moved in waiting[item & low].get(heads[state], ()):
                        if moved not in column and live[moved >> bits]:
                            column[moved] = None
                            agenda.append(moved)
                elif s in predicted:
                    moved = onward[state] << bits | item & low
                    if s in wait:
                        wait[s].append(moved)
                    else:
                        wait[s] = [moved]
                        for q in coming[s]:
                            new = q << bits | i
                            if new not in column:
                                column[new] = None
                                agenda.append(new)
                    if s in nullable and moved not in column and live[moved >> bits]:
                        column[moved] = None
                        agenda.append(moved)
                elif s in fitting:
                    state = onward[state]
                    if live_next[state]:
                        following[state << bits | item & low] = None
            if i < n:
                column, fitting, live, coming = following, fitting_next, live_next, coming_next
        return self.last[start] << bits in column

    def cost(self, start: str, tokens: tuple, below: int = 1 << 30) -> int:
        """The least number of tokens to insert, drop or replace so that the rest derives from start.

        Of costs not below `below` no more is told than that.
        """
        key = (start, tokens)
        known = self.costs.get(key)
        if known is None:
            known = self._repair(start, tokens, below)
            if known < below:
                if len(self.costs) > 50_000:
                    self.costs.clear()
                self.costs[key] = known
        return known

    def _states(self) -> tuple:
        """Dotted rules as numbers, those with one head and the same rest being one: first states of each nonterminal, and
        per state the symbol after the dot (None at the end), the rule's head and the state with the dot moved on."""
        if self.dotted is None:
            known: dict[tuple, int] = {}
            symbols, heads, onward = [], [], []
            for head, body in self.rules:
                for k in range(len(body), -1, -1):
                    if (head, body[k:]) not in known:
                        known[head, body[k:]] = len(symbols)
                        symbols.append(body[k] if k < len(body) else None)
                        heads.append(head)
                        onward.append(known[head, body[k + 1 :]] if k < len(body) else -1)
            self.numbers = {h: k for k, h in enumerate(self.by)}
            #: Whether no token class comes after the dot: tokens aren't dropped there, but at the states that follow.
            self.inner = [s is None or s in self.by for s in symbols]
            self.last = {h: known[h, ()] for h in self.by}
            self.dotted = {h: list(dict.fromkeys(known[h, self.rules[r][1]] for r in rs)) for h, rs in self.by.items()}, symbols, heads, onward
            self._find_beginnings()
        return self.dotted

    def _find_beginnings(self) -> None:
        """Which token classes the rest of each state can begin with, and whether it can be empty."""
        predicted, symbols, _, onward = self.dotted
        self.looking.clear()
        self.looks.clear()
        begins: dict[str, set[str]] = {h: set() for h in self.by}
        self.begins: list[set[str]] = [set() for _ in symbols]
        self.empty = [False] * len(symbols)
        grown = True
        while grown:
            grown = False
            for q, s in enumerate(symbols):
                # The state with the dot moved on has the smaller number.
                more = set(begins[s]) if s in begins else set() if s is None else {s}
                if s in self.nullable:
                    more |= self.begins[onward[q]]
                self.empty[q] = s is None or s in self.nullable and self.empty[onward[q]]
                if not more <= self.begins[q]:
                    self.begins[q] |= more
                    grown = True
            for h, states in predicted.items():
                for q in states:
                    begins[h] |= self.begins[q]

    def _looking(self, token) -> tuple[frozenset[str], list[bool], dict[str, list[int]]]:
        """With a token next, or none: the token classes it fits, per state whether its rest can begin there, and the first
        states of each nonterminal that can."""
        if token not in self.looking:
            fitting = frozenset() if token is None else self._fitting(token)
            if fitting not in self.looks:
                live = [e or not b.isdisjoint(fitting) for e, b in zip(self.empty, self.begins, strict=True)]
                self.looks[fitting] = fitting, live, {h: [q for q in states if live[q]] for h, states in self.dotted[0].items()}
            self.looking[token] = self.looks[fitting]
        return self.looking[token]

    def _fitting(self, token) -> frozenset[str]:
        """The token classes of the grammar that a token fits."""
        if token not in self.fitted:
            self.fitted[token] = frozenset(s for _, body in self.rules for s in body if s not in self.by and self.fits(s, token))
        return self.fitted[token]

    def _bounds(self, start: str) -> Bounds:
        if start not in self.bounds:
            self.bounds[start] = Bounds(self, start)
        return self.bounds[start]

    def _repair(self, start: str, tokens: tuple, below: int) -> int:
        """Chart parsing with error productions, items in order of a lower bound of the whole repair's cost.

        An item is a dotted rule, where it began and where it stands; its cost is the least to get there from the start.
        What a nonterminal costs on its own is added to whatever waits for it. Tokens are dropped only right before a
        token of the grammar or at the end, which every repair can be brought to. The bound of what is still to come
        only decides the order; an item reached at less cost later is taken up again, so the result is the least cost.
        An item that costs as much as the same one some tokens earlier and dropping these is left out: whatever goes on from
        it goes on from the earlier one, which drops them right before its next token of the grammar.
        """
        predicted, symbols, heads, onward = self._states()
        numbers, inner, n = self.numbers, self.inner, len(tokens)
        ahead = self._bounds(start).ahead(tokens)
        if min(ahead[0][q] for q in predicted[start]) >= below:
            return below
        # An item is its state, origin and place in one number.
        bits = (n + 1).bit_length()
        twice, low = 2 * bits, (1 << bits) - 1
        far = 1 << 30
        fitting = [self._fitting(t) for t in tokens]
        best: dict[int, int] = {}
        done: dict[int, int] = {}
        # By nonterminal and place: least cost there, what waits with its cost, and where it ends at what own cost.
        began: dict[int, int] = {numbers[start] << bits: 0}
        waiting: dict[int, list] = {}
        complete: dict[int, dict[int, int]] = {}
        least, goal = 0, below
        # One queue per bound; what is found below the present one joins it.
        queues: list[list[int]] = [[] for _ in range(max(ahead[0]) + n + 2)]
        for state in predicted[start]:
            best[state << twice] = 0
            queues[ahead[0][state]].append(state << twice)
        while least < len(queues) and least < goal:
            queue = queues[least]
            while queue:
                item = queue.pop()
                c = best[item]
                if done.get(item, far) <= c:
                    continue
                done[item] = c
                state, i = item >> twice, item & low
                s = symbols[state]
                here = ahead[i]
                if s is None:
                    head, origin = heads[state], item >> bits & low
                    if origin == 0 and head == start:
                        goal = min(goal, c + n - i)
                        if goal <= least:
                            break
                    key = numbers[head] << bits | origin
                    own = c - began[key]
                    ends = complete.get(key)
                    if ends is None:
                        ends = complete[key] = {}
                    if own < ends.get(i, far):
                        ends[i] = own
                        for waiter, k, then in waiting.get(key, ()):
                            new, to = k + own, waiter | i
                            if new >= best.get(to, far):
                                continue
                            if best.get(to - 1, far) < new:
                                if inner[then]:
                                    best[to] = new
                            elif (bound := new + here[then]) < goal:
                                best[to] = new
                                if bound >= len(queues):
                                    queues += [[] for _ in range(bound)]
                                queues[bound if bound > least else least].append(to)
                elif s in numbers:
                    # The waiting item with its dot moved on; its place is added when the nonterminal ends.
                    then = onward[state]
                    waiter = then << twice | item & low << bits
                    key = numbers[s] << bits | i
                    if key in waiting:
                        waiting[key].append((waiter, c, then))
                    else:
                        waiting[key] = [(waiter, c, then)]
                    if c < began.get(key, far):
                        began[key] = c
                        for q in predicted[s]:
                            to = q << twice | i << bits | i
                            if c < best.get(to, far) and (bound := c + here[q]) < goal:
                                best[to] = c
                                if bound >= len(queues):
                                    queues += [[] for _ in range(bound)]
                                queues[bound if bound > least else least].append(to)
                    known = complete.get(key)
                    if known:
                        for e, own in known.items():
                            new, to = c + own, waiter | e
                            if new >= best.get(to, far):
                                continue
                            if best.get(to - 1, far) < new:
                                if inner[then]:
                                    best[to] = new
                            elif (bound := new + ahead[e][then]) < goal:
                                best[to] = new
                                if bound >= len(queues):
                                    queues += [[] for _ in range(bound)]
                                queues[bound if bound > least else least].append(to)
                else:
                    then, dearer = onward[state], c + 1
                    to = then << twice | item & (1 << twice) - 1
                    if dearer < best.get(to, far) and (bound := dearer + here[then]) < goal:
                        best[to] = dearer
                        if bound >= len(queues):
                            queues += [[] for _ in range(bound)]
                        queues[bound if bound > least else least].append(to)
                    if i < n:
                        there = ahead[i + 1]
                        new, to = c if s in fitting[i] else dearer, to + 1
                        if new < best.get(to, far):
                            if best.get(to - 1, far) < new:
                                if inner[then]:
                                    best[to] = new
                            elif (bound := new + there[then]) < goal:
                                best[to] = new
                                if bound >= len(queues):
                                    queues += [[] for _ in range(bound)]
                                queues[bound if bound > least else least].append(to)
                        to = item + 1
                        if dearer < best.get(to, far) and (bound := dearer + there[state]) < goal:
                            best[to] = dearer
                            if bound >= len(queues):
                                queues += [[] for _ in range(bound)]
                            queues[bound if bound > least else least].append(to)
            least += 1
        return goal


class Bounds:
    """Lower bounds of repair costs: those towards the grammar's regular approximation, in which the end of a rule may
    go on after any occurrence of its head. That language holds the grammar's, so no repair costs less.

    Where a parse stands in the approximation is told by the tokens that may come next; states with the same ones are
    one place. A step is a token class together with the place behind it.
    """

    FAR = 1 << 20

    def __init__(self, g: Grammar, start: str):
        self.g = g
        predicted, symbols, heads, onward = g._states()
        reached, todo = set(), [start]
        while todo:
            h = todo.pop()
            if h not in reached:
                reached.add(h)
                todo += [s for r in g.by[h] for s in g.rules[r][1] if s in g.by]
        states = [q for q, h in enumerate(heads) if h in reached]
        after: dict[str, list[int]] = {h: [] for h in reached}
        for q in states:
            if symbols[q] in reached:
                after[symbols[q]].append(onward[q])

        def following(q: int) -> tuple:
            """What the next tokens depend on: the nonterminal after the dot, the head whose rule ends, or the state itself."""
            s = symbols[q]
            return ("end", heads[q]) if s is None else ("in", s) if s in reached else ("at", q)

        def tokens_next(f: tuple) -> frozenset[int]:
            seen, open_, found = {f}, [f], set()
            while open_:
                kind, x = open_.pop()
                if kind == "at":
                    found.add(x)
                    continue
                if kind == "end" and x == start:
                    found.add(-1)
                for q in after[x] if kind == "end" else predicted[x]:
                    y = following(q)
                    if y not in seen:
                        seen.add(y)
                        open_.append(y)
            return frozenset(found)

        nexts = {f: tokens_next(f) for f in {following(q) for q in states}}
        of_state = {q: nexts[following(q)] for q in states}
        # Steps that read the same class and lead to the same tokens are one.
        steps: dict[tuple, int] = {}
        step_of = {q: steps.setdefault((symbols[q], of_state[onward[q]]), len(steps)) for q in states if symbols[q] is not None and symbols[q] not in reached}
        step_of[-1] = -1
        places: dict[frozenset[int], int] = {}
        place = {n: places.setdefault(frozenset(step_of[q] for q in n), len(places)) for n in set(of_state.values())}
        self.place = np.zeros(len(symbols), np.int64)
        for q in states:
            self.place[q] = place[of_state[q]]
        self.behind = np.array([place[n] for _, n in steps], np.int64)
        self.symbols = [s for s, _ in steps]
        m, k = len(places), len(steps)
        direct = np.zeros((m, k), bool)
        ends = np.full(m, self.FAR, np.int32)
        for n, i in places.items():
            for x in n:
                if x < 0:
                    ends[i] = 0
                else:
                    direct[i, x] = True
        # Tokens to insert from place to place.
        between = np.full((m, m), self.FAR, np.int32)
        for i in range(m):
            between[i, self.behind[direct[i]]] = 1
            between[i, i] = 0
        for j in range(m):
            np.minimum(between, between[:, j : j + 1] + between[j], out=between)
        self.ends = np.minimum((between + ends).min(1), self.FAR)
        self.inserted = np.full((m, k), self.FAR, np.int32)
        for x in range(k):
            self.inserted[:, x] = between[:, direct[:, x]].min(1)
        self.misses: dict = {}

    def _miss(self, token) -> np.ndarray:
        if token not in self.misses:
            self.misses[token] = np.array([not self.g.fits(s, token) for s in self.symbols], np.int32)
        return self.misses[token]

    def ahead(self, tokens: tuple) -> list[list[int]]:
        """For each position and state the least cost of what is still to come."""
        here = self.ends
        out = [here]
        sums, least = np.empty_like(self.inserted), np.minimum.reduce
        for token in reversed(tokens):
            # A token is dropped, or read by the best step to insert up to.
            np.add(self.inserted, self._miss(token) + here[self.behind], out=sums)
            here = np.minimum(here + 1, least(sums, axis=1))
            out.append(here)
        return np.array(out[::-1])[:, self.place].tolist()
