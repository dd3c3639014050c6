"""Builds on request: who may ask for one, and that a scope is built once, whoever asks.

A job is a file on the shared store that one engine creates, which succeeds for one of them only. It holds the job's row and an end of its lease: the
row of a job that is not renewed until then, as its engine is gone, is taken over by the next one that asks.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from hashlib import sha256

from pointlens.operators.sampling import PERCENTAGES
from pointlens.operators.scope import Scope
from pointlens.plans.engine import Engine
from pointlens.sources.shared import create_once, overwrite, read_text, remove

LEASE = 3600.0  # seconds

#: What callers are told.
ONLY_SCOPES = "FPS-threshold generation is only supported for state and county views."
NEEDS_STATE = "A state abbreviation is required before generating state FPS-threshold data."
NEEDS_BOTH = "Both state and county are required before generating county FPS-threshold data."
COMPLETE = "Data precomputation is complete."
QUEUED = "Data precomputation is queued."
RUNNING = "Data precomputation is running."
FAILED = "Data precomputation failed: "
MISSING = "Data is not precomputed for this {}."


@dataclass
class Job:
    key: str
    zoom: str
    state: str
    county: str
    status: str
    message: str
    started_at: str
    finished_at: str | None
    owner: str
    until: float


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def refusal(zoom: str, state: str, county: str) -> str | None:
    """Why a scope is not built on request."""
    if zoom not in ("state", "county"):
        return ONLY_SCOPES
    if zoom == "state":
        return None if state else NEEDS_STATE
    return None if state and county else NEEDS_BOTH


class Jobs:
    """Jobs of an engine's folder. Engines with the same folder share them."""

    def __init__(self, engine: Engine, lease: float = LEASE):
        self.engine, self.lease, self.owner = engine, lease, uuid.uuid4().hex

    def _path(self, key: str) -> str:
        return f"{self.engine.path}/jobs/{sha256(key.encode()).hexdigest()[:32]}.json"

    @staticmethod
    def key(scope: Scope) -> str:
        return f"{scope.zoom}:{scope.state.upper()}:{scope.county.lower()}"

    def job(self, scope: Scope) -> Job | None:
        text = read_text(self.engine.spark, self._path(self.key(scope)))
        return Job(**json.loads(text)) if text else None

    def _write(self, job: Job) -> None:
        overwrite(self.engine.spark, self._path(job.key), json.dumps(asdict(job)))

    def take(self, scope: Scope) -> tuple[Job, bool]:
        """The scope's job and whether it is this engine's to run."""
        key = self.key(scope)
        fresh = Job(key, scope.zoom, scope.state, scope.county, "queued", QUEUED, _now(), None, self.owner, time.time() + self.lease)
        for _ in range(2):
            if create_once(self.engine.spark, self._path(key), json.dumps(asdict(fresh))):
                return fresh, True
            held = self.job(scope)
            if held is not None and held.status in ("queued", "running") and held.until > time.time():
                return held, False
            remove(self.engine.spark, self._path(key))  # it has ended, or its engine is gone
        return self.job(scope) or fresh, False

    def status(self, scope: Scope) -> dict:
        """What is there of a scope's curve, its job, and how far a build has come."""
        row = self.engine.status(scope).first().asDict()
        job = self.job(scope)
        expected = len(PERCENTAGES[scope.zoom])
        row["progress"] = round(100 * min(expected, row["row_count"] + self.engine.staged(scope)) / expected)
        row["generation_status"] = job.status if job and job.status != "done" else "available" if row["available"] else "missing"
        return row | ({"job": asdict(job)} if job else {})

    def missing(self, scope: Scope, method: str = "fps_threshold") -> dict | None:
        """The payload for a scope without a curve, None if there is one or the method needs none."""
        if method != "fps_threshold" or scope.zoom not in ("state", "county"):
            return None
        found = self.status(scope)
        if found["available"]:
            return None
        busy = found["generation_status"] in ("queued", "running")
        return found | {"points": [], "generation_supported": True, "message": found["job"]["message"] if busy else MISSING.format("County" if scope.zoom == "county" else "State")}

    def generate(self, zoom: str, state: str = "", county: str = "") -> dict:
        """Build a scope's curve, unless it is complete or under way, and return its status with the job's row."""
        zoom, state, county = zoom.strip().lower(), state.strip(), county.strip()
        if why := refusal(zoom, state, county):
            return {"available": False, "generation_supported": False, "message": why}
        scope = Scope(zoom, state, county if zoom == "county" else "")
        found = self.status(scope)
        if found["available"] and found["complete"]:
            return found | {"generation_status": "done", "message": COMPLETE}
        job, mine = self.take(scope)
        if not mine:
            return found | {"generation_status": job.status, "message": job.message, "job": asdict(job)}
        job.status, job.message = "running", RUNNING
        self._write(job)
        try:
            self.engine.build(scope)
        except Exception as e:
            job.status, job.message, job.finished_at = "error", f"{FAILED}{e}", _now()
            self._write(job)
            raise
        job.status, job.message, job.finished_at = "done", COMPLETE, _now()
        self._write(job)
        return self.status(scope) | {"generation_status": "done", "message": COMPLETE}
