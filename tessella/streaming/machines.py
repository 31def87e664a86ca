"""Keyed state machines on event streams, as stateful processors over the RocksDB state store.

Each machine folds the events of its key in the order of ``event_id``. A batch hands a processor the
rows of a key in any order, so it sorts those of one batch; between batches only the machine's small
state is held, and what grows (a history) is emitted, not kept. A restart from the checkpoint goes on
where the last committed batch ended, so the rows are the same however the stream is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def in_order(rows: Iterable[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r.event_id)


class TransientError(Exception):
    """A phase failure that may go away when it is tried again."""


#: A phase takes the event that runs it and gives its result and whether that is verified, or raises.
Phase = Callable[[Row], tuple[float, bool]]
FailHook = Callable[[Row, Exception], str | None]

RUNNABLE, RESUMABLE, IDEMPOTENT = ("queued", "checkpointed"), ("active", "checkpointed", "error"), ("queued", "active", "completed")


class JobPhases(StatefulProcessor):
    """Jobs that run phase by phase. Commands (column ``command``): ``enqueue`` makes a queued job,
    does nothing where one is queued, active or completed, and counts a conflict otherwise; ``step``
    runs the current phase of a queued or checkpointed job, which is then checkpointed at the next
    phase, completed, or in error; ``resume`` puts a job that is active, checkpointed or in error back
    to queued, with its phase. A verified result is the phase's known good one until a later one of
    the same phase takes its place."""

    OUTPUT = "job long, event_id long, state string, phase string, attempts long, conflicts long, outcome string, known_good map<string,double>, best double"
    out = Row("job", "event_id", "state", "phase", "attempts", "conflicts", "outcome", "known_good", "best")

    def __init__(self, phases: list[tuple[str, Phase]], fail_hook: FailHook | None = None):
        self.phases, self.fail_hook = phases, fail_hook

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "state string, phase int, attempts long, conflicts long, outcome string")
        self.known_good = handle.getMapState("known_good", "phase string", "result double")

    def _run(self, phase: int, event: Row) -> tuple[str, int, str | None]:
        """The state, phase and outcome after a phase."""
        name, work = self.phases[phase]
        try:
            result, verified = work(event)
        except Exception as error:  # any failure of a phase is classed
            outcome = self.fail_hook(event, error) if self.fail_hook else None
            outcome = outcome or ("transient" if isinstance(error, TransientError) else "permanent")
            return "cancelled" if outcome == "user_cancelled" else "error", phase, outcome
        if verified:
            self.known_good.updateValue((name,), (result,))
        last = phase + 1 == len(self.phases)
        return "completed" if last else "checkpointed", phase if last else phase + 1, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, phase, attempts, conflicts, outcome = self.job.get() if self.job.exists() else (None, None, 0, 0, None)
        last = None
        for event in in_order(rows):
            last = event.event_id
            if event.command == "enqueue":
                conflicts += state is not None and state not in IDEMPOTENT
                state = state or "queued"
            elif event.command == "resume" and state in RESUMABLE:
                state = "queued"
            elif event.command == "step" and state in RUNNABLE:
                attempts += 1
                state, phase, failed = self._run(phase or 0, event)
                outcome = failed or outcome
        self.job.update((state, phase, attempts, conflicts, outcome))
        good = {k[0]: v[0] for k, v in self.known_good.iterator()}
        best = good[max(good)] if good else None
        yield self.out(key[0], last, state, None if phase is None else self.phases[phase][0], attempts, conflicts, outcome, good, best)

    def close(self) -> None:
        pass


class Settle(StatefulProcessor):
    """Files that are seen until they rest. A snapshot (columns at, in milliseconds, and token, null
    where the file cannot be seen) that equals the one before it counts; ``calls`` equal ones in a row
    make the path stable and queue it, and later sightings are counted into that one entry. An attempt that is
    not stable ``timeout`` milliseconds after its first snapshot has timed out, by the next snapshot or
    by a timer where none comes, and a later snapshot begins another."""

    OUTPUT = "path long, seen long, queued_at long, token long, repeats long, timeouts long"
    out = Row("path", "seen", "queued_at", "token", "repeats", "timeouts")

    def __init__(self, calls: int, timeout: int):
        self.calls, self.timeout = calls, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.path = handle.getValueState("path", "seen long, queued_at long, token long, repeats long, timeouts long, begun long, runs int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, queued, token, repeats, timeouts, begun, runs = self.path.get() if self.path.exists() else (0, None, None, 0, 0, None, 0)
        had = begun
        for r in in_order(rows):
            seen += 1
            if queued is not None:
                repeats += 1
                continue
            if begun is not None and r.at > begun + self.timeout:
                timeouts, begun = timeouts + 1, None
            if begun is None:
                begun, token, runs = r.at, None, 0
            runs = 0 if r.token is None else runs + 1 if r.token == token else 1
            token = r.token
            if runs >= self.calls:
                queued = r.at
            elif r.at >= begun + self.timeout:
                timeouts, begun = timeouts + 1, None
        pending = begun if queued is None else None
        if had is not None and had != pending:
            self.handle.deleteTimer(had + self.timeout)
        if pending is not None and had != pending:
            self.handle.registerTimer(pending + self.timeout)
        self.path.update((seen, queued, token, repeats, timeouts, pending, runs))
        yield self.out(key[0], seen, queued, token if queued is not None else None, repeats, timeouts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, queued, token, repeats, timeouts, begun, runs = self.path.get()
        if begun is not None:
            timeouts += 1
            self.path.update((seen, queued, None, repeats, timeouts, None, 0))
            yield self.out(key[0], seen, queued, None, repeats, timeouts)

    def close(self) -> None:
        pass


class Rotation(StatefulProcessor):
    """A playlist's turns. Each tick (columns at, in milliseconds, open, override, members, order) gives
    one row: an override is shown at once; a closed window and an interval that has not passed show
    nothing; else the entry after the last shown one in the order is next, around its end. Only the
    last entry, its time and the number shown are held."""

    OUTPUT = "playlist long, event_id long, reason string, entry long, position int, shown long"
    out = Row("playlist", "event_id", "reason", "entry", "position", "shown")

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "last long, at long, shown long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, at, shown = self.turn.get() if self.turn.exists() else (None, None, 0)
        for r in in_order(rows):
            members, order = r.members or [], r.order or []
            entry = None
            if r.override is not None and r.override in members:
                reason, entry = "override", r.override
            elif not r.open:
                reason = "closed"
            elif at is not None and r.at - at < self.interval:
                reason = "wait"
            elif not order:
                reason = "empty"
            else:
                reason = "first" if at is None else "next"
                entry = order[(order.index(last) + 1) % len(order)] if last in order else order[0]
            if entry is not None:
                last, at, shown = entry, r.at, shown + 1
            yield self.out(key[0], r.event_id, reason, entry, None if entry is None else members.index(entry), shown)
        self.turn.update((last, at, shown))

    def close(self) -> None:
        pass
