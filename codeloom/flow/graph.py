"""Control-flow graph of one function.

Languages parse a body into a small tree of steps (``Step``); one builder turns
any such tree into nodes and edges.  Node 0 is the entry, node 1 the exit.  A
call is a node, never an expansion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WIDTH = 60
# fixed value: edge of the early return that a fallible call can take
ERR_EDGE = "Err ?"

Tails = list[tuple[int, str | None]]


class FlowError(ValueError):
    """No graph can be made; the message says why."""


class NoBody(FlowError):
    """A declaration that has no graph, as it has no body of its own."""


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip())


def label(text: str) -> str:
    text = one_line(text)
    return text if len(text) <= WIDTH else text[: WIDTH - 1] + "…"


def left_label(text: str) -> str:
    """Cut at the left: of a long chain the last name is the one called."""
    text = one_line(text)
    return text if len(text) <= WIDTH else "…" + text[-(WIDTH - 1) :]


@dataclass
class Call:
    label: str
    line: int
    fallible: bool = False


@dataclass
class Arm:
    label: str
    body: list[Step] = field(default_factory=list)
    before: list[Call] = field(default_factory=list)
    #: nothing flows on from it: what falls out goes to the exit
    diverges: bool = False
    #: enters the same body as the arm before it (labels on top of each other)
    labels: list[str] = field(default_factory=list)


@dataclass
class Step:
    """``kind``: calls, block, branch, match, loop, jump, try.

    jump: ``node`` is return, throw, break, continue, goto or yield.
    """

    kind: str
    line: int = 0
    text: str = ""
    calls: list[Call] = field(default_factory=list)
    body: list[Step] = field(default_factory=list)
    arms: list[Arm] = field(default_factory=list)
    node: str = ""
    name: str | None = None
    endless: bool = False
    breakable: bool = False
    falls: str | None = None
    final: list[Step] | None = None
    ordered: bool = False


@dataclass
class _Target:
    header: int
    name: str | None
    loop: bool
    depth: int
    breaks: Tails = field(default_factory=list)


class Builder:
    def __init__(self, function: dict):
        self.function = function
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.targets: list[_Target] = []
        self.finals: list[list[Step]] = []
        self.orders: dict[int, list[str]] = {}
        params = ", ".join(function["params"])
        name = f"{function['scope']}.{function['name']}" if function["scope"] else function["name"]
        self.node([], "entry", f"{name}({params})" + (f" -> {function['returns']}" if function["returns"] else ""), function["line"])
        self.node([], "exit", "end", function["end_line"])

    def node(self, tails: Tails, kind: str, text: str, line: int) -> int:
        n = len(self.nodes)
        self.nodes.append({"id": n, "kind": kind, "label": text, "line": line})
        self.join(tails, n)
        return n

    def join(self, tails: Tails, to: int) -> None:
        self.edges += [{"from": a, "to": to, "label": text} for a, text in tails]

    def build(self, body: list[Step]) -> dict:
        self.join(self.run(body, [(0, None)]), 1)
        for n, names in self.orders.items():
            # arms without nodes get their edge late; source order is restored per match
            slots = [k for k, e in enumerate(self.edges) if e["from"] == n]
            place = {text: k for k, text in reversed(list(enumerate(names)))}
            for k, e in zip(slots, sorted((self.edges[k] for k in slots), key=lambda e: place.get(e["label"], len(names))), strict=True):
                self.edges[k] = e
        return {"function": self.function, "nodes": self.nodes, "edges": self.edges}

    def run(self, steps: list[Step], tails: Tails) -> Tails:
        for s in steps:
            if not tails:
                break  # nothing reaches the rest
            tails = getattr(self, f"_{s.kind}")(s, tails)
        return tails

    def _calls(self, s: Step, tails: Tails) -> Tails:
        return self.made(s.calls, tails)

    def made(self, calls: list[Call], tails: Tails) -> Tails:
        for c in calls:
            n = self.node(tails, "call", c.label, c.line)
            if c.fallible:
                self.edges.append({"from": n, "to": 1, "label": ERR_EDGE})
            tails = [(n, None)]
        return tails

    def _block(self, s: Step, tails: Tails) -> Tails:
        return self.run(s.body, self.made(s.calls, tails))

    def _branch(self, s: Step, tails: Tails, kind: str = "branch") -> Tails:
        n = self.node(self.made(s.calls, tails), kind, s.text, s.line)
        target = None
        if s.breakable:
            target = _Target(n, None, False, len(self.finals))
            self.targets.append(target)
        out: Tails = []
        for arm in s.arms:
            entry: Tails = [(n, text) for text in arm.labels or [arm.label]]
            left = self.run(arm.body, self.made(arm.before, entry))
            if arm.diverges:
                self.join(left, 1)
            else:
                out += left
        if target:
            self.targets.pop()
            out += target.breaks
        if s.falls is not None:
            out.append((n, s.falls))
        if not s.arms and s.falls is None:
            out.append((n, None))
        if s.ordered:
            self.orders[n] = [text for arm in s.arms for text in arm.labels or [arm.label]]
        return out

    def _match(self, s: Step, tails: Tails) -> Tails:
        return self._branch(s, tails, "match")

    def _loop(self, s: Step, tails: Tails) -> Tails:
        n = self.node(self.made(s.calls, tails), "loop", s.text, s.line)
        target = _Target(n, s.name, True, len(self.finals))
        self.targets.append(target)
        back = self.run(s.body, [(n, "body")])
        self.targets.pop()
        self.join([(a, text or "repeat") for a, text in back], n)
        return target.breaks + ([] if s.endless else [(n, "done")])

    def _jump(self, s: Step, tails: Tails) -> Tails:
        tails = self.made(s.calls, tails)
        if s.node == "yield":
            return [(self.node(tails, "yield", s.text, s.line), None)]
        if s.node == "goto":
            self.node(tails, "goto", s.text, s.line)
            return []
        target = None
        if s.node in ("break", "continue"):
            fits = [t for t in self.targets if (t.loop or s.node == "break") and (s.name is None or t.name == s.name)]
            target = fits[-1] if fits else None
        tails = self.unwind(target.depth if target else 0, tails)
        n = self.node(tails, s.node, s.text, s.line)
        if s.node == "break" and target:
            target.breaks.append((n, None))
        elif s.node == "continue":
            if target:
                self.join([(n, None)], target.header)
        else:
            self.join([(n, None)], 1)
        return []

    def unwind(self, depth: int, tails: Tails) -> Tails:
        """Run a copy of every open ``finally`` above ``depth``, innermost first."""
        whole = self.finals
        for k in range(len(whole) - 1, depth - 1, -1):
            self.finals = whole[:k]
            tails = self.run(whole[k], tails)
            if not tails:
                break
        self.finals = whole
        return tails

    def _try(self, s: Step, tails: Tails) -> Tails:
        n = self.node(tails, "branch", "try", s.line)
        if s.final is not None:
            self.finals = [*self.finals, s.final]
        out = self.run(s.body, [(n, "try")])
        for arm in s.arms:
            out += self.run(arm.body, self.made(arm.before, [(n, arm.label)]))
        if s.final is None:
            return out
        self.finals = self.finals[:-1]
        return self.run(s.final, out)
