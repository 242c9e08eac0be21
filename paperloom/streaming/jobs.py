"""Jobs that must not fail as a whole, their state, and a watcher that follows the settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import Settings
from ..functions.text import is_stale
from ..image.engines import no_reader
from ..operators import catalogue as cat
from ..schemas import SKU_CATALOGUE
from ..sinks import tables as sinks
from ..sources import tables as sources
from . import runs

#: When the catalogue was synced, and from where.
SYNCED = "synced_at string, source string"
STATE = "at string, status string, activity string, run string, documents long, rows long, flagged long, error string"


def now_text() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class Synced:
    """What a sync did: whether it replaced the catalogue, its counters and its warnings."""

    refreshed: bool
    entries: int
    rows_read: int = 0
    skipped: int = 0
    warnings: list[str] = field(default_factory=list)


def sync_catalogue(fetch: Callable[[], DataFrame] | None, store: runs.Store, now: str, max_age_hours: int, source: str = "") -> Synced:
    """Replaces a stale catalogue by what ``fetch()`` gives as ``(pos, sku, barcode)``.

    A fetch that fails leaves the old table, which stays in use, and warns; so do
    barcodes with several SKUs, of which the first is kept, and a catalogue that
    was never set up.
    """
    known = store.table("catalogue", SKU_CATALOGUE)
    entries = known.count()
    if fetch is None:
        return Synced(False, entries, warnings=[] if entries else ["no catalogue is set up; SKUs come from readings alone"])
    last = store.table("catalogue-synced", SYNCED).agg(F.max("synced_at").alias("at"))
    fresh = last.select(is_stale(F.col("at"), F.lit(entries), F.lit(now), max_age_hours).alias("stale")).first()
    if not fresh["stale"]:
        return Synced(False, entries)
    try:
        path = store.path("work/catalogue")  # fetched once; the source may be slow or change meanwhile
        fetch().write.mode("overwrite").parquet(path)
        raw = store.spark.read.parquet(path)
        cleaned = cat.clean(raw)
        report, refused = cat.read_report(raw).first(), cat.conflicts(cleaned).collect()
        sinks.replace(cat.first_wins(cleaned), store.path("catalogue"))
        sinks.replace(store.spark.createDataFrame([(now, source)], SYNCED), store.path("catalogue-synced"))
        sinks.remove(store.spark, path)
    except Exception as error:  # noqa: BLE001  whatever the source raises, the old catalogue serves
        reason = str(error).splitlines()[0] if str(error) else type(error).__name__
        kept = f"the catalogue was not synced, the old one of {entries} entries stays" if entries else "the catalogue could not be fetched"
        return Synced(False, entries, warnings=[f"{kept}: {reason}"])
    warnings = []
    if refused:
        first = refused[0]
        shown = f"{len(refused)} or more" if len(refused) >= cat.CONFLICTS_SHOWN else str(len(refused))
        warnings.append(f"{shown} conflicting rows in the catalogue: {first['barcode']} is {first['kept']}, not {first['refused']}")
    return Synced(True, report["entries"], report["rows_read"], report["skipped"], warnings)


@dataclass(frozen=True)
class State:
    status: str = "idle"
    activity: str | None = None
    run: str | None = None
    documents: int = 0
    rows: int = 0
    flagged: int = 0
    error: str | None = None


class Jobs:
    """One job at a time, and every change of state as a row of a table.

    A job that is asked for while another works, or while the engine is off, is
    refused: ``begin`` says so and nothing is run.
    """

    def __init__(self, store: runs.Store, enabled: bool = True):
        self.store, self.enabled = store, enabled
        self.state = State("idle" if enabled else "off")
        self._busy, self._lock, self._listeners = False, Lock(), []

    def subscribe(self, listener: Callable[[State], None]) -> Callable[[], None]:
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener)

    def update(self, **changes) -> None:
        self.state = replace(self.state, **changes)
        row = {"at": now_text(), **asdict(self.state)}
        self.store.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").json(self.store.path("state"))
        for listener in list(self._listeners):
            listener(self.state)

    def history(self) -> DataFrame:
        if not sources.exists(self.store.spark, self.store.path("state")):
            return self.store.spark.createDataFrame([], STATE)
        return self.store.spark.read.schema(STATE).json(self.store.path("state"))

    def enable(self, enabled: bool) -> None:
        self.enabled = enabled
        if not self._busy:
            self.update(status="idle" if enabled else "off", activity=None)

    def begin(self, activity: str) -> bool:
        with self._lock:
            if self._busy or not self.enabled:
                return False
            self._busy = True
        self.update(status="busy", activity=activity, error=None)
        return True

    def end(self) -> None:
        self._busy = False
        if self.state.status == "busy":
            self.update(status="idle" if self.enabled else "off", activity=None)

    def run(self, run: str, pages: DataFrame, scanned_at: str | None = None, invoices: str | None = None) -> DataFrame | None:
        """Processes page records as a job; the summary, or None if it was refused or failed."""
        if not self.begin(f"run {run}"):
            return None
        try:
            summary = runs.process(pages, self.store, run, scanned_at or self.store.scan_time(run), invoices)
            row = summary.first()
            self.update(status="idle", activity=None, run=run, documents=row["documents"], rows=row["rows_appended"], flagged=row["flagged_rows"], error=None)
            return summary
        except Exception as error:  # noqa: BLE001  a failed job is a state, and the next one may work
            self.update(status="error", activity=None, run=run, error=str(error).splitlines()[0] if str(error) else type(error).__name__)
            return None
        finally:
            self.end()

    def sync(self, fetch: Callable[[], DataFrame] | None, max_age_hours: int = 0, source: str = "") -> Synced | None:
        """Syncs the catalogue as a job; None if it was refused."""
        if not self.begin("catalogue"):
            return None
        try:
            found = sync_catalogue(fetch, self.store, now_text(), max_age_hours, source)
            if found.warnings and not found.refreshed:
                self.update(status="error", error=found.warnings[0])
            return found
        finally:
            self.end()


class Watching(StreamingQueryListener):
    """Takes what happens to a query into the jobs' state."""

    def __init__(self, jobs: Jobs, name: str):
        self.jobs, self.name, self._id = jobs, name, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._id = event.id
            self.jobs.update(activity="watching")

    def onQueryProgress(self, event) -> None:
        if event.progress.id == self._id and event.progress.numInputRows:
            self.jobs.update(activity=f"{event.progress.numInputRows} files arrived")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self._id and event.exception:
            self.jobs.update(status="error", activity=None, error=str(event.exception).splitlines()[0])


class Watcher:
    """The hot folder's query, started and stopped as the settings say."""

    NAME = "hot-folder"

    def __init__(self, jobs: Jobs, reader=no_reader):
        self.jobs, self.reader = jobs, reader
        self.query: StreamingQuery | None = None
        self._listener: Watching | None = None
        self._settings: Settings | None = None

    @property
    def watching(self) -> bool:
        return self.query is not None and self.query.isActive

    def apply(self, settings: Settings, enabled: bool = True) -> bool:
        """Starts, restarts or stops the query; True if it watches now.

        A query that already follows the same settings goes on.
        """
        self.jobs.enable(enabled)
        wanted = enabled and bool(settings.hot_folder)
        if wanted and self.watching and settings == self._settings:
            return True
        self.stop()
        if not wanted:
            return False
        spark: SparkSession = self.jobs.store.spark
        self._listener = Watching(self.jobs, self.NAME)
        spark.streams.addListener(self._listener)
        checkpoint = settings.checkpoint_dir or self.jobs.store.path("checkpoints/hot-folder")
        self.query = runs.watch(settings.hot_folder, self.jobs.store, checkpoint, self.reader, f"{settings.quiet_seconds} seconds", settings.invoices_root or None, self.NAME)
        self._settings = settings
        return True

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
        if self._listener is not None:
            self.jobs.store.spark.streams.removeListener(self._listener)
            self._listener = None


def describe(state: State) -> str:
    """One line about the state, as a status bar shows it."""
    if state.status == "busy":
        return f"busy: {state.activity or 'working'}"
    if state.error:
        return f"{state.status}: {state.error}"
    if state.run is None:
        return state.status
    flagged = f", {state.flagged} flagged" if state.flagged else ""
    return f"{state.status}: {state.documents} documents, {state.rows} rows{flagged}"

