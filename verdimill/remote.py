"""Models behind a wire: one attempt is a transport's call; dialects write requests and read answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from .scorers import CallError, Scorer, retry_after
from .wire import DIALECTS, Dialect, media_blocks

#: One attempt: the body of a request to (status, headers, body of the response).  Connection errors are raised.
Transport = Callable[[str], tuple[int, dict, str]]


@dataclass
class WireScorer(Scorer):
    """A scorer over any transport; failures carry the status and what a Retry-After header asks for.

    The version that a response reports is kept in ``reported``; the answers are those the wire reads, invalid ones included.
    """

    transport: Transport
    model: str
    dialect: Dialect = field(default_factory=lambda: DIALECTS["native"])
    extra: dict = field(default_factory=dict)
    reported: str = field(default="", init=False)
    remote = True

    def _send(self, body: str) -> str:
        try:
            status, headers, text = self.transport(body)
        except (ConnectionError, TimeoutError):
            raise
        except OSError as e:
            raise CallError(str(e), 0) from e
        if status != 200:
            after = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
            raise CallError(f"status {status}", status, retry_after(after) if after else None)
        return text

    def _read(self, text: str, questions: dict) -> dict[str, dict]:
        r = self.dialect.response(text, questions, self.model)
        self.reported = r.model or self.reported
        return r.answers

    def ask(self, state, questions):
        return self._read(self._send(self.dialect.request(state, questions, self.model, self.extra)), questions)

    def ask_media(self, state: str, files: list[tuple[str, bytes | str]], questions: dict) -> dict[str, dict]:
        """Questions about a text and its files (content type, and bytes or an address)."""
        body = json.loads(self.dialect.request(state, questions, self.model, self.extra))
        return self._read(self._send(json.dumps(body | {"state": media_blocks(state, files)}, ensure_ascii=False)), questions)
