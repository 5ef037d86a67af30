"""Redaction and restoring of chunked streams with state for each session (Structured Streaming, RocksDB state).

Chunks (session, seq, chunk, is_last) are buffered up to the last sentence end, so that values cut by chunk borders are
found whole. Within a micro-batch rows are taken by seq; a session's batches follow each other. is_last flushes the rest
and clears the session's state.
State holds the buffer and two maps, original -> stand-in and original -> audit code, apart from each other, so that a
value that returns in a later chunk gets its stand-in in the downstream text and its code in the audit text. The salt is
configuration and never part of the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.operators.entities import Detector
from maskwright.operators.frames import override_strategies, three_forms
from maskwright.operators.replacing import restore
from maskwright.plans.profiles import with_profile

# Sentence ends, and how much is held without one.
BOUNDARIES = "\n。.！!？?；;"
MOST_HELD = 4096
STATE_VERSION = 1
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def split_at_boundary(held: str, chunk: str, most: int | None = MOST_HELD, flush: bool = False) -> tuple[str, str]:
    """What is ready and what is held on: up to the last sentence end, or all when flushed or too long."""
    text = held + chunk
    cut = max(text.rfind(b) for b in BOUNDARIES) + 1
    if flush or (cut == 0 and most is not None and len(text) >= most):
        return text, ""
    return text[:cut], text[cut:]


class SessionRedactor:
    """The same without Spark: feed chunks, flush, export and load the state."""

    def __init__(self, *, salt, lang="zh", strategy_overrides=None, display_marker=None, state: dict | None = None, most=MOST_HELD, **options):
        if salt is None:
            raise ValueError("a salt is needed, so that all chunks get the same stand-ins")
        self.salt, self.marker, self.most = salt, display_marker, most
        self.detector = Detector(lang, **options)
        self.config = override_strategies(with_profile("pseudonym-llm", None, None)[0], strategy_overrides)
        state = state or {"version": STATE_VERSION, "buffer": "", "fakes": {}, "codes": {}}
        if state.get("version") != STATE_VERSION:
            raise ValueError(f"state version {state.get('version')!r}; this code reads {STATE_VERSION}")
        self.buffer, self.fakes, self.codes = state["buffer"], dict(state["fakes"]), dict(state["codes"])

    def feed(self, chunk: str, flush: bool = False) -> dict | None:
        """The forms of what is ready, or None. fakes and codes are kept as original -> replacement."""
        ready, self.buffer = split_at_boundary(self.buffer, chunk, self.most, flush)
        if not ready:
            return None
        flip = lambda m: {v: k for k, v in m.items()}
        r = three_forms(self.detector, ready, salt=self.salt, config=self.config, existing=flip(self.fakes), audit_existing=flip(self.codes), marker=self.marker)
        for own, key in ((self.fakes, r["real_key"]), (self.codes, r["audit_key"])):
            for replacement, original in key.items():
                own.setdefault(original, replacement)
        return {k: r[k] for k in ("audit_text", "downstream_text", "display_text")} | {"text": ready}

    def flush(self) -> dict | None:
        return self.feed("", flush=True)

    def key(self) -> dict[str, str]:
        return {r: o for m in (self.fakes, self.codes) for o, r in m.items()}

    def export(self) -> dict:
        """The state without the salt."""
        return {"version": STATE_VERSION, "buffer": self.buffer, "fakes": dict(self.fakes), "codes": dict(self.codes)}


class _Redactor(StatefulProcessor):
    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "value string")
        self.fakes = handle.getMapState("fakes", "original string", "replacement string")
        self.codes = handle.getMapState("codes", "original string", "replacement string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.buffer.get()[0] if self.buffer.exists() else ""
        read = lambda m: {k[0]: v[0] for k, v in m.iterator()} if m.exists() else {}
        session = SessionRedactor(state={"version": STATE_VERSION, "buffer": held, "fakes": read(self.fakes), "codes": read(self.codes)}, **self.options)
        before = (dict(session.fakes), dict(session.codes))
        out, batch = [], pd.concat(rows)
        for r in batch.sort_values("seq", kind="stable").itertuples():
            forms = session.feed(r.chunk or "", bool(r.is_last))
            if forms:
                out.append((key[0], int(r.seq), forms["audit_text"], forms["downstream_text"], forms["display_text"]))
        if bool(batch["is_last"].any()):  # the session is over: nothing of it is kept
            self.buffer.clear(), self.fakes.clear(), self.codes.clear()
            yield pd.DataFrame(out, columns=["session", "seq", "audit_text", "downstream_text", "display_text"])
            return
        self.buffer.update((session.buffer,))
        for state, old, new in ((self.fakes, before[0], session.fakes), (self.codes, before[1], session.codes)):
            for original, replacement in new.items():
                if original not in old:
                    state.updateValue((original,), (replacement,))
        yield pd.DataFrame(out, columns=["session", "seq", "audit_text", "downstream_text", "display_text"])

    def close(self) -> None:
        pass


class _Restorer(StatefulProcessor):
    def __init__(self, strategy: str):
        self.strategy = strategy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out, over = self.buffer.get()[0] if self.buffer.exists() else "", [], False
        for r in pd.concat(rows).sort_values("seq", kind="stable").itertuples():
            ready, held = split_at_boundary(held, r.chunk or "", None, bool(r.is_last))
            if ready:
                out.append((key[0], int(r.seq), restore(ready, dict(r.key or {}))))
            over = over or bool(r.is_last)
        self.buffer.clear() if over else self.buffer.update((held,))
        yield pd.DataFrame(out, columns=["session", "seq", "text"])

    def close(self) -> None:
        pass


def redact_stream(chunks: DataFrame, *, salt, lang="zh", **options) -> DataFrame:
    """chunks: streaming frame of session string, seq long, chunk string, is_last boolean."""
    if salt is None:
        raise ValueError("a salt is needed, so that all chunks get the same stand-ins")
    Detector(lang)
    return chunks.groupBy("session").transformWithStateInPandas(
        _Redactor({"salt": salt, "lang": lang, **options}), "session string, seq long, audit_text string, downstream_text string, display_text string", "Append", "None"
    )


def restore_stream(chunks: DataFrame, strategy: str = "sentence") -> DataFrame:
    """chunks: session, seq, chunk, is_last and key (map). "none" restores each chunk by itself, without state."""
    from maskwright.operators.frames import restore_text

    if strategy not in ("sentence", "none"):
        raise ValueError(f"unknown strategy {strategy!r}; known: sentence, none")
    if strategy == "none":
        return restore_text(chunks, "chunk", "key", out="text").select("session", "seq", "text")
    return chunks.groupBy("session").transformWithStateInPandas(_Restorer(strategy), "session string, seq long, text string", "Append", "None")
