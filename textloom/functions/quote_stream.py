"""Parser of answers that carry quotes in tags, for text that arrives in pieces.

Events: text; quote_open and quote (or quote_abandoned, for one that never closes or runs over 1500 characters);
not_found for a leading [[NOT_FOUND]]. Raw tags never come out, and the text events joined, and all others in order, are the same
however the input is cut. The state is a small tuple, so it can be kept between micro-batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed values.
SENTINEL, OPEN, CLOSE = "[[NOT_FOUND]]", "<quote", "</quote>"
TAG_LIMIT, QUOTE_LIMIT = 80, 1500
_DOC = re.compile(r"doc\s*=\s*[\"']?\s*([A-Za-z]?\d+)", re.I)
_OPEN, _CLOSE = re.compile(re.escape(OPEN), re.I), re.compile(re.escape(CLOSE), re.I)

Event = dict[str, str]


def held_back(text: str, *tokens: str) -> int:
    """How many last characters may be the start of a token."""
    low = text.lower()
    return max((k for t in tokens for k in range(1, min(len(t), len(low) + 1)) if low.endswith(t[:k])), default=0)


@dataclass
class Parser:
    default_tag: str = "D1"
    mode: str = "start"
    pending: str = ""
    quote: str = ""
    tag: str = ""
    count: int = 0
    events: list[Event] = field(default_factory=list)

    # -- state to and from a row

    def state(self) -> tuple[str, str, str, str, int]:
        return self.mode, self.pending, self.quote, self.tag, self.count

    @classmethod
    def restored(cls, state: tuple[str, str, str, str, int], default_tag: str = "D1") -> Parser:
        mode, pending, quote, tag, count = state
        return cls(default_tag, mode, pending, quote, tag, count)

    # -- input

    def push(self, piece: str) -> list[Event]:
        self.pending += piece
        return self._run(last=False)

    def end(self, reason: str = "complete") -> list[Event]:
        out = self._run(last=True)
        if self.mode == "quote":
            out.append(self._quote_event("quote_abandoned", reason="stopped" if reason == "stopped" else "truncated"))
        elif self.mode != "swallow" and self.pending:
            out.append({"type": "text", "text": self.pending})
        self.mode, self.pending = "text", ""
        return out

    def _run(self, last: bool) -> list[Event]:
        self.events = []
        # Each step handles one mode and says whether another may follow on what is pending.
        while getattr(self, f"_{self.mode}")(last):
            pass
        return self.events

    def _say(self, text: str) -> None:
        if text:
            self.events.append({"type": "text", "text": text})

    def _quote_event(self, kind: str, **more: str) -> Event:
        return {"type": kind, "id": f"c{self.count}", "tag": self.tag, "text": self.quote, **more}

    # -- modes

    def _start(self, last: bool) -> bool:
        lead = self.pending.lstrip()
        if lead[: len(SENTINEL)].upper() == SENTINEL:
            self.events.append({"type": "not_found"})
            self.pending, self.mode = lead[len(SENTINEL) :], "line_end"
        elif not last and SENTINEL.startswith(lead.upper()):
            return False
        else:
            self.mode = "text"
        return True

    def _line_end(self, last: bool) -> bool:
        self.pending = self.pending.lstrip(" \t")
        if not last and self.pending in ("", "\r"):
            return False
        self.pending = re.sub(r"\A\r?\n", "", self.pending)
        self.mode = "text"
        return True

    def _text(self, last: bool) -> bool:
        opened = _OPEN.search(self.pending)
        end = opened.start() if opened else len(self.pending)
        body, rest = self.pending[:end], self.pending[end:]
        body = _CLOSE.sub("", body)
        keep = 0 if opened or last else held_back(body, OPEN, CLOSE)
        self._say(body[: len(body) - keep])
        self.pending = body[len(body) - keep :] + rest
        if opened:
            self.mode = "open"
        return bool(opened)

    def _open(self, last: bool) -> bool:
        after = self.pending[len(OPEN) : len(OPEN) + 1]
        end = self.pending.find(">")
        plain = bool(after) and not (after.isspace() or after == ">")
        if not plain and end < 0 and len(self.pending) <= TAG_LIMIT and not last:
            return False
        if plain or end < 0 or end > TAG_LIMIT:
            self._say(self.pending[: len(OPEN)])
            self.pending, self.mode = self.pending[len(OPEN) :], "text"
            return True
        told = _DOC.search(self.pending[: end + 1])
        name = told.group(1).upper() if told else self.default_tag
        self.tag = name if name.startswith("D") else f"D{told.group(1)}" if told else name
        self.count += 1
        self.quote, self.pending, self.mode = "", self.pending[end + 1 :], "quote"
        self.events.append({"type": "quote_open", "id": f"c{self.count}", "tag": self.tag})
        return True

    def _quote(self, last: bool) -> bool:
        closed = _CLOSE.search(self.pending)
        keep = 0 if closed or last else held_back(self.pending, CLOSE)
        end = closed.start() if closed else len(self.pending) - keep
        self.quote += self.pending[:end]
        self.pending = self.pending[closed.end() :] if closed else self.pending[end:]
        if len(self.quote) > QUOTE_LIMIT:
            # How much had come by then depends on the cuts; the text of an overlong quote is dropped.
            self.quote = ""
            self.events.append(self._quote_event("quote_abandoned", reason="truncated"))
            self.mode = "text" if closed else "swallow"
            return True
        if closed:
            self.events.append(self._quote_event("quote"))
            self.mode = "text"
        return bool(closed)

    def _swallow(self, last: bool) -> bool:
        closed = _CLOSE.search(self.pending)
        if closed:
            self.pending, self.mode = self.pending[closed.end() :], "text"
            return True
        self.pending = self.pending[len(self.pending) - (0 if last else held_back(self.pending, CLOSE)) :]
        return False


def parse(text: str, default_tag: str = "D1", reason: str = "complete") -> list[Event]:
    """Events of a whole text."""
    p = Parser(default_tag)
    return joined([*p.push(text), *p.end(reason)])


def joined(events: list[Event]) -> list[Event]:
    """Neighbouring text events as one."""
    out: list[Event] = []
    for e in events:
        if e["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": out[-1]["text"] + e["text"]}
        else:
            out.append(e)
    return out
