"""Logs that grow: appended lines update a session's counters, and nothing is read again.

A log arrives in chunks of whole lines with the byte offset where each begins. The state of a log is one
row of mergeable folds, the next offset expected, and a map of the files read so far. A chunk
that comes early waits in a map by its offset until the gap before it is filled, and one that
comes again is passed over; so the state grows with gaps and distinct files, never with the log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.functions import text as X
from turnwise.operators import normalize as N
from turnwise.operators import sessions as Se

FOLD = (
    "at long, line long, turns long, tokens long, tool_tokens long, errors long, run long, depth long, sample long, "
    "growth long, rereads long, held long"
)
REPORT = (
    "log_id string, read_to long, turns long, estimated_tokens long, tool_output_tokens long, failed_commands long, "
    "retry_depth_max long, context_growth_events long, rereads long, waiting boolean"
)


#: Lines and files of a log that a call keeps in memory before it asks the state for each.
MOST_HELD = 50_000
#: Early lines under one key of the state.
LINES_A_KEY = 256


class GrowingLog(StatefulProcessor):
    """Counters of `Se.session_metrics` over the lines of a log in order of (at, line).

    The state is asked for a file once in a call and told of it once at the end. Early lines of a call wait in
    memory and go to the state only if their gap is still open at its end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._fold = handle.getValueState("fold", FOLD)
        self._files = handle.getMapState("files", "file string", "n long")
        self._early = handle.getMapState("early", "at long, part long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        names = [f.split()[0] for f in FOLD.split(", ")]
        saved = self._fold.get()
        s = dict(zip(names, saved, strict=True)) if saved else dict.fromkeys(names, 0)
        self._seen: dict[str, int] = {}
        self._waiting: dict[tuple[int, int], dict[int, list]] = {}
        self._n = 0
        if 0 < s["held"] <= MOST_HELD:
            for (at, part), (text,) in self._early.iterator():
                self._waiting[(at, part)] = {int(k): v for k, v in json.loads(text).items()}
            self._early.clear()
            self._n, s["held"] = s["held"], 0
        for chunk in rows:
            chunk = chunk.sort_values(["at", "line"], kind="stable")
            fields = ("at", "line", "lines", "size", "tokens", "is_tool", "is_error", "files")
            for row in zip(*[chunk[c] for c in fields], strict=True):
                at, line, lines, size, tokens, tool, error, files = row
                here = (int(at), int(line))
                if here < (s["at"], s["line"]):
                    continue
                value = [int(lines), int(size), int(tokens), bool(tool), bool(error), [] if files is None else [str(f) for f in files]]
                if here == (s["at"], s["line"]):
                    self._release(s, here)
                    self._take(s, *value)
                else:
                    self._hold(s, here, value)
            while (value := self._release(s, (s["at"], s["line"]))) is not None:
                self._take(s, *value)
        self._write_early(s)
        self._write_files()
        self._fold.update(tuple(s[n] for n in names))
        open_sample = s["turns"] > Se.SAMPLE_EVERY and s["turns"] % Se.SAMPLE_EVERY and s["sample"] > Se.GROWTH_TOKENS
        yield pd.DataFrame(
            {
                "log_id": [key[0]],
                "read_to": [s["at"]],
                "turns": [s["turns"]],
                "estimated_tokens": [s["tokens"]],
                "tool_output_tokens": [s["tool_tokens"]],
                "failed_commands": [s["errors"]],
                "retry_depth_max": [s["depth"]],
                "context_growth_events": [s["growth"] + int(open_sample)],
                "rereads": [s["rereads"]],
                "waiting": [s["held"] > 0],
            }
        )

    def _stored(self, s: dict, block: tuple[int, int]) -> dict[int, list]:
        if not s["held"] or not self._early.containsKey(block):
            return {}
        return {int(k): v for k, v in json.loads(self._early.getValue(block)[0]).items()}

    def _hold(self, s: dict, here: tuple[int, int], value: list) -> None:
        block = (here[0], here[1] // LINES_A_KEY)
        lines = self._waiting.setdefault(block, {})
        if here[1] not in lines and here[1] not in self._stored(s, block):
            lines[here[1]] = value
            self._n += 1
            if self._n > MOST_HELD:
                self._write_early(s)

    def _release(self, s: dict, here: tuple[int, int]) -> list | None:
        """The early line at this place, which no longer waits; None if there is none."""
        block = (here[0], here[1] // LINES_A_KEY)
        value = self._waiting.get(block, {}).pop(here[1], None)
        if value is not None:
            self._n -= 1
            return value
        stored = self._stored(s, block)
        value = stored.pop(here[1], None)
        if value is not None:
            s["held"] -= 1
            if stored:
                self._early.updateValue(block, (json.dumps(stored),))
            else:
                self._early.removeKey(block)
        return value

    def _write_early(self, s: dict) -> None:
        for block, lines in self._waiting.items():
            if lines:
                self._early.updateValue(block, (json.dumps(self._stored(s, block) | lines),))
        s["held"] += self._n
        self._waiting, self._n = {}, 0

    def _write_files(self) -> None:
        for file, n in self._seen.items():
            self._files.updateValue((file,), (n,))
        self._seen = {}

    def _take(self, s: dict, lines: int, size: int, tokens: int, tool: bool, error: bool, files: list[str]) -> None:
        if lines:
            self._turn(s, tokens, tool, error)
        for file in files:
            seen = self._seen.get(file)
            if seen is None:
                seen = int(self._files.getValue((file,))[0]) if self._files.containsKey((file,)) else 0
            s["rereads"] += seen > 0
            self._seen[file] = seen + 1
            if len(self._seen) > MOST_HELD:
                self._write_files()
        s["line"] += 1
        if s["line"] >= lines:
            s["at"], s["line"] = s["at"] + size, 0

    def _turn(self, s: dict, tokens: int, tool: bool, error: bool) -> None:
        s["turns"] += 1
        s["tokens"] += tokens
        s["tool_tokens"] += tokens if tool else 0
        s["errors"] += error
        s["run"] = s["run"] + 1 if error else s["run"] if tool else 0
        s["depth"] = max(s["depth"], s["run"])
        s["sample"] += tokens
        if s["turns"] % Se.SAMPLE_EVERY == 0:
            s["growth"] += s["turns"] > Se.SAMPLE_EVERY and s["sample"] > Se.GROWTH_TOKENS
            s["sample"] = 0

    def close(self) -> None:
        pass


def growing_sessions(turns: DataFrame) -> DataFrame:
    """The counters so far of each log that a batch adds to (columns of REPORT).

    `turns` has log_id (string), at, line, lines, size, tokens, is_tool, is_error and files (array of
    names) for each line of a chunk; a chunk without lines is one row with `lines` 0.
    """
    fields = ("at", "line", "lines", "size", "tokens", "is_tool", "is_error", "files")
    rows = turns.select("log_id", *fields)
    return rows.groupBy("log_id").transformWithStateInPandas(GrowingLog(), REPORT, "Update", "None")


def turns_of_chunks(chunks: DataFrame) -> DataFrame:
    """Lines of chunks (`log_id`, `at`, `content`) as turns; narrow. A chunk has whole lines."""
    lines = F.filter(F.transform(F.split("content", "\n"), X.trimmed), lambda x: x != "")
    parts = chunks.select(
        F.col("log_id").cast("string").alias("log_id"), F.col("at").cast("long").alias("at"),
        F.octet_length("content").cast("long").alias("size"), lines.alias("_lines"),
    )
    rows = parts.select("log_id", "at", "size", F.size("_lines").alias("lines"), F.posexplode_outer("_lines").alias("line", "raw"))
    rows = rows.withColumns({"line": F.coalesce("line", F.lit(0)), "raw": F.coalesce("raw", F.lit(""))})
    turns = N.turns_of(rows)
    return turns.withColumns({"tokens": X.token_estimate(F.col("text")), "files": X.file_reads(F.col("text"))})
