"""A small local service: captures are sent in or named, run one at a time, and their plans fetched."""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable
from email import message_from_bytes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from planspark.plans import config
from planspark.sources import files

ENDS = ("done", "failed", "interrupted")


class Jobs:
    """Jobs by id, kept in one file that is replaced as a whole; what was unfinished at a start is interrupted."""

    def __init__(self, folder: Path):
        folder.mkdir(parents=True, exist_ok=True)
        self.folder, self.index, self.lock = folder, folder / "jobs.json", threading.Lock()
        held = json.loads(self.index.read_text()) if self.index.exists() else {}
        self.rows: dict[str, dict[str, Any]] = {k: {**j, "status": j["status"] if j["status"] in ENDS else "interrupted"} for k, j in held.items()}
        self._keep()

    def _keep(self) -> None:
        files.write_atomic(self.index, json.dumps(self.rows, indent=1))

    def put(self, job: str, **values: Any) -> dict[str, Any]:
        with self.lock:
            self.rows.setdefault(job, {"id": job, "created": time.time()}).update(values)
            self._keep()
            return dict(self.rows[job])

    def newest(self) -> list[dict[str, Any]]:
        with self.lock:
            return sorted(self.rows.values(), key=lambda j: (-j["created"], j["id"]))


class Service:
    """Queue of jobs; ``make(path, out, settings)`` writes a plan and returns its path."""

    def __init__(self, folder: Path, make: Callable[[Path, Path, dict], Path], home: Path | None = None):
        self.jobs, self.make, self.home, self.waiting = Jobs(folder), make, (home or Path.home()).resolve(), queue.Queue()
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while True:
            job = self.waiting.get()
            row = self.jobs.put(job, status="running", started=time.time())
            try:
                place = self.jobs.folder / job
                path = Path(row["local"]) if row.get("local") else files.locate(place / "input")[0]
                plan = self.make(path, place / "out", config.load(row["profile"]))
                self.jobs.put(job, status="done", plan=str(plan), finished=time.time())
            except Exception as e:  # a job that fails says why, and the next one runs
                self.jobs.put(job, status="failed", error=f"{type(e).__name__}: {e}"[:300], finished=time.time())
            self.waiting.task_done()

    def submit(self, sent: dict[str, bytes] | None = None, local: str | None = None, profile: str = "lite", label: str = "") -> dict[str, Any]:
        """A new job of sent files, or of a capture below the home folder."""
        if profile not in config.PROFILES:
            raise ValueError(f"unknown profile {profile}")
        job = uuid.uuid4().hex[:12]
        if local is not None:
            path = Path(local).expanduser().resolve()
            if not path.is_relative_to(self.home) or not path.exists():
                raise ValueError("captures must lie below the home folder")
            row = self.jobs.put(job, label=label or path.name, profile=profile, local=str(path), n_files=0, status="queued")
        else:
            if not sent:
                raise ValueError("no files")
            files.store_upload(self.jobs.folder / job / "input", sent)
            row = self.jobs.put(job, label=label or job, profile=profile, n_files=len(sent), status="queued")
        self.waiting.put(job)
        return row

    def answer(self, method: str, path: str, kind: str = "", body: bytes = b"") -> tuple[int, str, bytes]:
        """(status, content type, body) of a request."""
        as_json = lambda code, value: (code, "application/json", json.dumps(value).encode())
        parts = [p for p in path.split("?")[0].split("/") if p]
        try:
            if method == "GET" and not parts:
                rows = "".join(f"<li>{j['id']} {j['status']}</li>" for j in self.jobs.newest())
                return 200, "text/html", f"<!doctype html><title>planspark</title><ul>{rows}</ul>".encode()
            if method == "GET" and parts == ["api", "info"]:
                return as_json(200, {"profiles": sorted(config.PROFILES), "jobs": len(self.jobs.rows)})
            if parts[:2] == ["api", "jobs"]:
                if method == "GET" and len(parts) == 2:
                    return as_json(200, self.jobs.newest())
                if method == "POST" and parts[2:] == ["local"]:
                    own = json.loads(body)
                    return as_json(202, self.submit(local=own["path"], profile=own.get("profile", "lite"), label=own.get("label", "")))
                if method == "POST" and len(parts) == 2:
                    return as_json(202, self.submit(sent=multipart(kind, body)))
                if method == "GET" and len(parts) in (3, 4) and (row := self.jobs.rows.get(parts[2])):
                    if len(parts) == 3:
                        return as_json(200, row)
                    if parts[3] in ("plan.json", "plan.svg") and row.get("plan"):
                        return 200, "image/svg+xml" if parts[3].endswith("svg") else "application/json", Path(row["plan"]).with_name(parts[3]).read_bytes()
        except (ValueError, KeyError) as e:
            return as_json(400, {"error": str(e)})
        return as_json(404, {"error": "not found"})


def multipart(kind: str, body: bytes) -> dict[str, bytes]:
    """Files by name of a form that was sent in parts."""
    message = message_from_bytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    if not message.is_multipart():
        raise ValueError("not a form of parts")
    return {name: part.get_payload(decode=True) for part in message.get_payload() if (name := part.get_filename())}


def serve(host: str, port: int, folder: Path) -> None:
    from planspark.__main__ import planned

    service = Service(folder, planned)

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, data = service.answer(self.command, self.path, self.headers.get("Content-Type", ""), body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply  # noqa: N815

    ThreadingHTTPServer((host, port), Handler).serve_forever()
