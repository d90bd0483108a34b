"""Models behind one small interface, and the step that asks them.

A backend answers a list of messages with a response: ``{"choices": [{"message": {"content": ...}}]}``. Spark
carries a factory to the workers, and each worker makes its own backend once (``WorkerBackend``).
"""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from ..functions.text import EXIT_WORDS
from ..settings import Settings

Message = dict[str, Any]


class Backend(Protocol):
    def complete(self, messages: list[Message]) -> dict: ...


def reply(content: str | None) -> dict:
    return {"choices": [{"message": {"content": content}}]}


@dataclass
class EchoBackend:
    """Answers ``prefix`` and the question; fails where ``fails`` says so of the question. Counts its calls."""

    prefix: str = "echo: "
    fails: Callable[[str], bool] = lambda question: False
    calls: int = 0

    def complete(self, messages: list[Message]) -> dict:
        self.calls += 1
        question = messages[-1]["content"]
        if self.fails(question):
            raise RuntimeError("the model is not available")
        return reply(self.prefix + question)


@dataclass
class ReplayBackend:
    """Answers a question as recorded; one that isn't recorded has no choices."""

    answers: dict[str, str | None]
    calls: int = 0

    def complete(self, messages: list[Message]) -> dict:
        self.calls += 1
        question = messages[-1]["content"]
        return reply(self.answers[question]) if question in self.answers else {"choices": []}


@dataclass
class HttpBackend:
    """A chat-completions service: one request for each call, a timeout, no retries."""

    settings: Settings

    def complete(self, messages: list[Message]) -> dict:
        if not self.settings.base_url:
            raise ValueError("no service address is set")
        body = json.dumps({"model": self.settings.model, "messages": messages, "temperature": self.settings.temperature}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.settings.api_key}"}
        request = urllib.request.Request(f"{self.settings.base_url.rstrip('/')}/chat/completions", body, head)
        with urllib.request.urlopen(request, timeout=self.settings.timeout_s) as answer:
            return json.load(answer)


#: The backends that this worker has made, by their factories' names; the last few.
_made: dict[str, Backend] = {}


@dataclass(frozen=True)
class WorkerBackend:
    """A factory whose backend is made once in each worker, whatever conversations, tasks and micro-batches it serves."""

    factory: Callable[[], Backend]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __call__(self) -> Backend:
        if self.name not in _made:
            while len(_made) >= 8:
                del _made[next(iter(_made))]
            _made[self.name] = self.factory()
        return _made[self.name]


@dataclass
class Conversation:
    """Its committed messages, and whether an exit word has ended it."""

    messages: list[Message] = field(default_factory=list)
    ended: bool = False


@dataclass(frozen=True)
class Outcome:
    question: str
    answer: str | None
    status: str
    error: str | None
    elapsed_s: float
    n_messages: int


def ask(
    conversation: Conversation, line: str | None, backend: Backend, clock: Callable[[], float] = time.monotonic, asking: Callable[[int], None] = lambda n_messages: None
) -> Outcome | None:
    """One line: None if it ends the conversation, comes after its end or is blank; else what came of the question.

    ``asking`` is told before the call how many messages the request has. A question is committed with its answer, or not at all. Batch, stream and command line all go through here.
    """
    question = (line or "").strip()
    if conversation.ended or question.lower() in EXIT_WORDS:
        conversation.ended = True
        return None
    if not question:
        return None
    request = [*conversation.messages, {"role": "user", "content": question}]
    asking(len(request))
    start = clock()
    try:
        answer = backend.complete(request)["choices"][0]["message"]["content"]
    except Exception as e:  # noqa: BLE001  any failure is this question's outcome
        return Outcome(question, None, "error", f"{type(e).__name__}: {e}", clock() - start, len(request))
    conversation.messages = [*request, {"role": "assistant", "content": answer}]
    return Outcome(question, answer, "ok", None, clock() - start, len(request))


def take(conversation: Conversation, outcome: Outcome) -> Outcome:
    """Commits an answer that was given before, without asking; a failure leaves no trace, as ever."""
    if outcome.status == "ok":
        conversation.messages = [*conversation.messages, {"role": "user", "content": outcome.question}, {"role": "assistant", "content": outcome.answer}]
    return outcome
