"""The command language over the log: parse, then execute one command or a whole script.

Commands: PING, VSET, VSEARCH, TSET, TSEARCH, HGETALL, DELETE (DEL, TDEL), INFO, SAVE, FLUSHDB,
QUIT, and IMPORT for files. Names are case-insensitive. Writes collect in batches that become one
append each; reads are plans over the last snapshot and the log rows since.
"""

from __future__ import annotations

import logging
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import atoi, check_text
from lodestar.functions.vectors import parse_literal
from lodestar.operators import store
from lodestar.operators.embedding import Embedder, embed_column
from lodestar.operators.search import THRESHOLD, nearest
from lodestar.sources.config import Settings
from lodestar.sources.imports import import_lines
from lodestar.sources.snapshots import last_version, load_snapshot, save_snapshot

VERSION = "0.2"
BATCH = 2000
HGETALL_LIMIT = 100
_log = logging.getLogger("lodestar")


class CommandError(Exception):
    """A refused command; its text is the reply without ``-ERR``."""


@dataclass
class Command:
    name: str
    id: str = ""
    text: str = ""
    vector: list[float] | None = None
    k: int = 0
    pattern: str = "*"
    limit: int | None = HGETALL_LIMIT


def first_word(line: str) -> tuple[str, str]:
    """The next word, double quotes taken off, and what follows it."""
    line = line.lstrip(" ")
    if line.startswith('"'):
        close = line.find('"', 1)
        return (line[1:], "") if close < 0 else (line[1:close], line[close + 1 :].lstrip(" "))
    word, _, rest = line.partition(" ")
    return word, rest.lstrip(" ")


def unquoted(text: str) -> str:
    """A leading quote goes, and with it a trailing one."""
    return text[1:].removesuffix('"') if text.startswith('"') else text


_ALIASES = {"DEL": "DELETE", "TDEL": "DELETE"}


def parse(line: str, dim: int) -> Command:
    """One command line. Raises CommandError for what isn't one."""
    word, rest = first_word(line.rstrip("\r\n"))
    name = _ALIASES.get(word.upper(), word.upper())
    if name in ("PING", "INFO", "SAVE", "FLUSHDB", "QUIT"):
        return Command(name)
    if name in ("VSET", "TSET"):
        key, rest = first_word(rest)
        return Command(name, key, vector=parse_literal(rest, dim) if rest else None) if name == "VSET" else Command(name, key, unquoted(rest))
    if name in ("VSEARCH", "TSEARCH"):
        k, rest = first_word(rest)
        return Command(name, k=atoi(k), vector=parse_literal(rest, dim) if rest else None) if name == "VSEARCH" else Command(name, k=atoi(k), text=unquoted(rest))
    if name == "HGETALL":
        pattern, rest = first_word(rest)
        if pattern.upper() == "LIMIT":
            pattern, rest = "*", f"LIMIT {rest}"
        word, number = first_word(rest)
        return Command(name, pattern=pattern or "*", limit=atoi(number) if word.upper() == "LIMIT" else HGETALL_LIMIT)
    if name == "DELETE":
        return Command(name, first_word(rest)[0])
    raise CommandError("unknown or unsupported command")


def split_stream(data: str) -> tuple[list[str], str]:
    """Whole lines that end in CR LF, and the unfinished rest."""
    *lines, rest = data.split("\r\n")
    return lines, rest


@dataclass
class Engine:
    """A store under a folder that all executors reach; ``execute`` takes one command line.

    With ``autosave`` a command that finds unsaved writes saves them, if the last save is
    ``settings.save_interval`` seconds back (0: never).
    """

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    embedder: Embedder | None = None
    metric: str = "cosine"
    pending: list[tuple] = field(default_factory=list)
    seq: int = -1
    closed: bool = False
    dirty: bool = False
    saved: tuple[str, int] | None = None
    autosave: bool = False
    saved_at: float = field(default_factory=time.monotonic)

    def __post_init__(self) -> None:
        if self.embedder and self.embedder.dim != self.settings.dim:
            raise ValueError("the embedder's size isn't the index's")
        last = self.log().agg(F.max("seq")).first()[0]
        self.seq = -1 if last is None else last
        self.saved = last_version(self.spark, self._snapshots)

    @property
    def _snapshots(self) -> str:
        return f"{self.root}/snapshots"

    def log(self) -> DataFrame:
        """All log rows, those not yet appended included."""
        from pyspark.errors import AnalysisException

        try:
            kept = self.spark.read.schema(store.LOG).parquet(f"{self.root}/log")
        except AnalysisException:
            kept = self.spark.createDataFrame([], store.LOG)
        return kept.union(self.spark.createDataFrame(self.pending, store.LOG)) if self.pending else kept

    def flush(self) -> None:
        """Append the pending rows as one file."""
        if self.pending:
            self.spark.createDataFrame(self.pending, store.LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
            self.pending = []

    def _append(self, op: str, key: str | None = None, vector: list[float] | None = None) -> None:
        self.seq += 1
        self.pending.append((self.seq, op, key, vector))
        self.dirty = True
        if len(self.pending) >= BATCH:
            self.flush()

    def nodes(self) -> DataFrame:
        if self.saved is None:
            return store.nodes(self.log(), self.metric)
        version, seq = self.saved
        # A filter that the scan of the log takes: files of rows that are saved already are passed over.
        return store.nodes_since(load_snapshot(self.spark, self._snapshots, version), self.log().where(F.col("seq") > seq), self.metric)

    def _embed(self, text: str) -> list[float]:
        if self.embedder is None:
            raise CommandError("no embedding model")
        return [float(x) for x in self.embedder.embed(text)]

    def _search(self, k: int, vector: list[float]) -> DataFrame:
        return nearest(self.nodes(), vector, k, self.metric, THRESHOLD)

    def execute(self, line: str) -> str | DataFrame:
        """The reply: a status line or a table. Raises CommandError where the reply is an error."""
        reply = self._execute(line)
        if self.autosave and self.dirty and 0 < self.settings.save_interval <= time.monotonic() - self.saved_at:
            self.save()
        return reply

    def save(self) -> None:
        """Append what is pending and write the nodes as a new snapshot."""
        self.flush()
        self.saved = save_snapshot(self.nodes(), self._snapshots, self.seq), self.seq
        self.dirty, self.saved_at = False, time.monotonic()

    def _execute(self, line: str) -> str | DataFrame:
        c = parse(line, self.settings.dim)
        if c.name == "PING":
            return "+PONG"
        if c.name == "QUIT":
            self.flush()
            self.closed = True
            return "+OK bye"
        if c.name in ("VSET", "TSET"):
            if not c.id or (c.name == "VSET" and c.vector is None):
                raise CommandError("missing data")
            if c.name == "TSET" and (error := check_text(c.text, self.settings.max_text_length)):
                raise CommandError(error)
            self._append(store.SET, c.id, c.vector if c.name == "VSET" else self._embed(c.text))
            return "+OK"
        if c.name in ("VSEARCH", "TSEARCH"):
            vector = c.vector if c.name == "VSEARCH" else self._embed(c.text)
            if vector is None:
                raise CommandError("missing search vector")
            return self._search(c.k, vector)
        if c.name == "HGETALL":
            return store.hgetall(self.nodes(), c.pattern, c.limit)
        if c.name == "DELETE":
            last = store.since_flush(self.log()).where(F.col("id") == c.id).orderBy(F.desc("seq")).first()
            if last is None or last.op == store.DELETE:
                raise CommandError("not found")
            self._append(store.DELETE, c.id)
            return "+OK"
        if c.name == "INFO":
            now = {"version": VERSION, "pid": os.getpid(), "path": self.root, "model": type(self.embedder).__name__ if self.embedder else "none", "dirty": int(self.dirty)}
            return store.info(self.nodes(), {**now, **{k: v for k, v in self.settings.as_dict().items() if k != "dim"}})
        if c.name == "SAVE":
            self.save()
            return "+OK"
        self._append(store.FLUSH)
        return "+OK"

    def run(self, lines: list[str]) -> list[str | DataFrame]:
        """Replies to a script; errors become ``-ERR`` lines."""
        replies: list[str | DataFrame] = []
        for line in lines:
            try:
                replies.append(self.execute(line))
            except CommandError as e:
                _log.info("refused: %s", e)
                replies.append(f"-ERR {e}")
        return replies

    def import_file(self, path: str) -> int:
        """Bulk TSET of ``id|text`` lines: one job that validates, embeds and appends. Returns the rows stored."""
        if self.embedder is None:
            raise CommandError("no embedding model")
        from lodestar.functions.text import is_valid

        self.flush()
        rows = import_lines(self.spark, path).where(is_valid("text", self.settings.max_text_length))
        placed = rows.withColumn("at", F.monotonically_increasing_id()).select((F.lit(self.seq + 1) + F.col("at")).alias("seq"), F.lit(store.SET).alias("op"), "id", embed_column("text", self.embedder).alias("embedding"))
        # Counted while they are written: the log isn't read again.
        seen = Observation()
        placed.observe(seen, F.count("*").alias("n"), F.max("seq").alias("last")).write.mode("append").parquet(f"{self.root}/log")
        n, last = seen.get["n"], seen.get["last"]
        if n:
            self.seq, self.dirty = last, True
        return n

    def restore(self) -> DataFrame | None:
        """The nodes of the last SAVE."""
        return load_snapshot(self.spark, self._snapshots)


def resp(reply: str | DataFrame, most: int = 10_000) -> str:
    """A reply in the wire format: a status line, or an array with the cells of its (limited) rows."""
    if isinstance(reply, str):
        return f"{reply}\r\n"
    rows = reply.limit(most).collect()
    cells = []
    for r in rows:
        for x in r:
            text = f"{x:.6f}" if isinstance(x, float) else str(x)
            cells.append(f"${len(text.encode())}\r\n{text}\r\n")
    return f"*{len(rows)}\r\n" + "".join(cells)


def read_resp(data: str) -> list[str] | str:
    """The cells of a wire reply, or its status line."""
    if data[:1] != "*":
        return data.rstrip("\r\n")
    at, cells = data.index("\r\n") + 2, []
    raw = data[at:].encode()
    while raw:
        head, _, raw = raw.partition(b"\r\n")
        size = int(head[1:])
        cells.append(raw[:size].decode())
        raw = raw[size + 2 :]
    return cells
