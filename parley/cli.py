"""The command line: questions about one document, until an exit word or the end of input.

Answers and notes about their progress go to standard output, errors to standard error. Status 1: a setting or the
document is missing or can't be read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from .errors import DocumentError, DocumentNotFound, SettingsError
from .operators.models import Backend, Conversation, HttpBackend, ask
from .operators.prompts import build_system_prompt
from .settings import Settings, load_settings
from .sources.documents import require_document


def _lines(read: Callable[[str], str]) -> Iterable[str]:
    while True:
        try:
            yield read(">> ")
        except (EOFError, KeyboardInterrupt):
            return


def chat(content: str, backend: Backend, lines: Iterable[str], out: TextIO, err: TextIO, limit: int = Settings.large_document) -> Conversation:
    """The session itself, over any lines and backend."""
    if len(content) > limit:
        print(f"Note: the document has {len(content)} characters; requests may be slow or exceed the model's context.", file=out)
    print("Ask about the document (exit to leave).\n", file=out)
    talk = Conversation([{"role": "system", "content": build_system_prompt(content)}])
    for line in lines:
        # the line stays open while the model is asked
        o = ask(talk, line, backend, asking=lambda n: print(f"[{n} messages] asking ... ", end="", file=out, flush=True))
        if talk.ended:
            print("Goodbye.", file=out)
            break
        if o is None:
            continue
        print(f"{'answered' if o.status == 'ok' else 'failed'} after {o.elapsed_s:.2f} s", file=out, flush=True)
        print(o.answer if o.status == "ok" else f"The model could not be asked: {o.error}", file=out if o.status == "ok" else err)
    return talk


def main(backend: Backend | None = None, lines: Iterable[str] | None = None) -> int:
    try:
        settings = load_settings()
    except SettingsError as e:
        print(f"Error: {e}.", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").appName("parley").getOrCreate()
    print(f"Reading {settings.document}\n")
    try:
        content = require_document(spark, settings.document)
    except DocumentNotFound:
        print(f"Error: there is no file {settings.document}.", file=sys.stderr)
        return 1
    except DocumentError as e:
        print(f"Error: the file can't be read: {e}.", file=sys.stderr)
        return 1
    print(f"Loaded {len(content)} characters.")
    chat(content, backend or HttpBackend(settings), lines or _lines(input), sys.stdout, sys.stderr, settings.large_document)
    return 0
