"""A plain version of the state: one session, one operation after the other.  The fold's expressions are held against it."""

import re
from dataclasses import dataclass, field

from sessionloom.functions import redact as R

#: kind -> id prefix, in the order of importance; and how many may be active.
PREFIX = {"constraint": "C", "goal": "G", "current_step": "S", "next_action": "N", "dead_end": "X", "decision": "D", "open_thread": "O", "env_fact": "F", "question": "Q"}
LIMIT = {"goal": 1, "current_step": 1, "next_action": 3}
WORDS = {"text": 60, "why": 40, "quote": 50}


def plain_words(text: str) -> str:
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def quote_form(text: str) -> str:
    words = (re.sub(r"^[^\w]+|[^\w]+$", "", w).lower() for w in text.split())
    return " ".join(w for w in words if w)


def path_words(text: str) -> list[str]:
    own = (w.strip("`'\",;:()[]") for w in text.split())
    return [w for w in own if "/" in w and "." in w and "://" not in w]


@dataclass
class Item:
    id: str
    seq: int
    kind: str
    text: str
    why: str | None = None
    quote: str | None = None
    sources: list[tuple[int, int]] = field(default_factory=list)
    status: str = "active"
    detail: str | None = None
    confidence: str = "medium"
    last_confirmed: int = 0


@dataclass
class Batch:
    """What a batch of operations may refer to."""

    start: int
    end: int
    visible: list[int]
    human: list[str]
    paths: list[str] = field(default_factory=list)


def _is_range(value) -> bool:
    pair = (value.get("start"), value.get("end")) if isinstance(value, dict) else tuple(value) if isinstance(value, list) else ()
    return len(pair) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in pair)


def _are_words(op: dict, keys) -> str | None:
    return next((f"{k} is no text" for k in keys if op.get(k) is not None and not isinstance(op[k], str)), None)


def malformed(op: dict) -> str | None:
    """What is wrong with an operation's fields, or None: they come from a model and may have any shape."""
    name = op.get("op")
    if not isinstance(name, str):
        return "no operation"
    ids = op.get("ids", [op["id"]] if "id" in op else [])
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        return "an id is no text"
    if name in ("update", "resolve", "drop", "confirm") and not isinstance(op.get("id"), str) or name in ("supersede", "merge") and not ids:
        return "no id"
    if name in ("resolve", "confirm") and not (isinstance(op.get("evt"), int) and not isinstance(op["evt"], bool)):
        return "no evt"
    new = {"add": op, "supersede": op.get("replacement"), "merge": op.get("merged")}.get(name)
    if name in ("add", "supersede", "merge") and not isinstance(new, dict):
        return "no new item"
    for part, key in ((new, "sources"), (op, "add_sources")):
        ranges = part.get(key) if isinstance(part, dict) else None
        if ranges is not None and not (isinstance(ranges, list) and all(map(_is_range, ranges))):
            return f"{key} are no ranges of events"
    return _are_words(op, ("text", "why", "reason")) or (_are_words(new, (*WORDS, "kind", "confidence")) if isinstance(new, dict) else None)


def _ranges(value) -> list[tuple[int, int]]:
    return [(min(a, b), max(a, b)) for a, b in ((r["start"], r["end"]) if isinstance(r, dict) else r for r in value or [])]


class State:
    def __init__(self) -> None:
        self.items: list[Item] = []
        self._n: dict[str, int] = {}

    def get(self, id_: str) -> Item | None:
        return next((i for i in self.items if i.id == id_), None)

    def active(self, kind: str) -> list[Item]:
        return [i for i in self.items if i.kind == kind and i.status == "active"]

    # -- checks

    def why_not(self, op: dict, batch: Batch, added: dict[str, int]) -> str | None:
        """The reason against an operation, or None.  Checks come in a fixed order."""
        if reason := malformed(op):
            return reason
        name = op["op"]
        for id_ in op.get("ids") or ([op["id"]] if "id" in op else []):
            item = self.get(id_)
            if item is None:
                return f"unknown item {id_}"
            if item.status != "active":
                return f"item {id_} is not active"
        if name == "drop" and self.get(op["id"]).kind == "constraint":
            return "a constraint is superseded, never dropped"
        inside = lambda a, b: batch.start <= a and b <= batch.end
        if name in ("resolve", "confirm") and not inside(op["evt"], op["evt"]):
            return f"evt {op['evt']} is outside the chunk"
        if name == "update" and not all(inside(*r) for r in _ranges(op.get("add_sources"))):
            return "a source is outside the chunk"
        new = {"add": op, "supersede": op.get("replacement"), "merge": op.get("merged")}.get(name)
        if new is None:
            return None if name in ("update", "resolve", "drop", "confirm") else f"unknown operation {name}"
        if reason := self._why_not_new(new, batch, inside):
            return reason
        limit = LIMIT.get(new["kind"], 0)
        if name == "add" and limit > 1:
            if len(self.active(new["kind"])) + added.get(new["kind"], 0) >= limit:
                return f"at most {limit} active of {new['kind']}"
            added[new["kind"]] = added.get(new["kind"], 0) + 1
        return None

    def _why_not_new(self, new: dict, batch: Batch, inside) -> str | None:
        if new.get("kind") not in PREFIX:
            return f"unknown kind {new.get('kind')}"
        for key in WORDS:
            if new.get(key) is not None:
                new[key] = redact_text(str(new[key]).strip())
        if not new.get("text"):
            return "empty text"
        for key in ("text", "why"):
            if len((new.get(key) or "").split()) > WORDS[key]:
                return f"{key} is longer than {WORDS[key]} words"
        sources = _ranges(new.get("sources"))
        if not sources:
            return "no source"
        if not all(inside(*r) for r in sources):
            return "a source is outside the chunk"
        if not any(a <= e <= b for a, b in sources for e in batch.visible):
            return "no cited event is visible"
        if new["kind"] == "constraint":
            quote = new.get("quote")
            if not quote:
                return "a constraint needs a quote"
            if len(quote.split()) > WORDS["quote"]:
                return f"quote is longer than {WORDS['quote']} words"
            if not any(quote_form(quote) in quote_form(h) for h in batch.human):
                return "the quote is in no human message"
        if any(not any(w in p for p in batch.paths) for w in path_words(new["text"])):
            new["confidence"] = "low"
        return None

    # -- application

    def _insert(self, new: dict) -> Item:
        prefix = PREFIX[new["kind"]]
        self._n[prefix] = self._n.get(prefix, 0) + 1
        sources = _ranges(new.get("sources"))
        item = Item(f"{prefix}{self._n[prefix]}", len(self.items), new["kind"], new["text"], new.get("why"), new.get("quote"), sources, confidence=new.get("confidence", "medium"), last_confirmed=max((b for _, b in sources), default=0))
        self.items.append(item)
        return item

    @staticmethod
    def _cite(item: Item, ranges: list[tuple[int, int]]) -> None:
        item.sources += [r for r in ranges if r not in item.sources]
        item.last_confirmed = max((b for _, b in item.sources), default=item.last_confirmed)

    def apply(self, op: dict) -> None:
        name = op["op"]
        if name == "add":
            same = next((i for i in self.active("constraint") if plain_words(i.text) == plain_words(op["text"]) != ""), None) if op["kind"] == "constraint" else None
            if same is not None:
                self._cite(same, _ranges(op.get("sources")))
                return
            new = self._insert(op)
            old = self.active(op["kind"])
            for item in old[: max(0, len(old) - LIMIT.get(op["kind"], len(old)))]:
                item.status, item.detail = "superseded", new.id
        elif name in ("supersede", "merge"):
            new = self._insert(op["replacement"] if name == "supersede" else op["merged"])
            for id_ in op.get("ids") or [op["id"]]:
                item = self.get(id_)
                item.status, item.detail = "superseded", new.id
        elif name == "update":
            item = self.get(op["id"])
            item.text, item.why = op.get("text") or item.text, op.get("why") or item.why
            self._cite(item, _ranges(op.get("add_sources")))
        elif name == "resolve":
            item = self.get(op["id"])
            item.status, item.detail = "resolved", str(op["evt"])
        elif name == "drop":
            item = self.get(op["id"])
            item.status, item.detail = "dropped", op.get("reason")
        elif name == "confirm":
            item = self.get(op["id"])
            last = max(item.last_confirmed, op["evt"])
            self._cite(item, [(op["evt"], op["evt"])])
            item.last_confirmed = max(last, item.last_confirmed)


_SECRETS = [re.compile(p) for p in R.DEFAULT.values()]


def redact_text(text: str) -> str:
    for p in _SECRETS:
        text = p.sub(R.REDACTED, text)
    return text


def replay(batches: list[tuple[str, Batch, list[dict]]]) -> tuple[State, list[tuple[str, int, str, str]]]:
    """Fold the batches in order: (chunk, what it may cite, operations) -> the state, and (chunk, op index, op, reason) of the refused.

    All operations of a batch are checked against the state before it.
    """
    state, refused = State(), []
    for chunk, batch, ops in batches:
        added: dict[str, int] = {}
        good = []
        for k, op in enumerate(ops):
            reason = state.why_not(op, batch, added)
            if reason is None:
                good.append(op)
            else:
                refused.append((chunk, k, str(op.get("op")), reason))
        for op in good:
            state.apply(op)
    return state, refused
