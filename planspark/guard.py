"""Commands under a memory limit, health lines, and waiting for jobs."""

from __future__ import annotations

import os
import signal
import subprocess
import time
from collections import Counter
from collections.abc import Callable, Iterable
from pathlib import Path


def resident_mb(pid: int) -> float:
    """Memory of a process and all its children, in MB; processes that have ended count nothing."""
    total, todo = 0, [pid]
    while todo:
        own = todo.pop()
        try:
            total += int(Path(f"/proc/{own}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
            for task in Path(f"/proc/{own}/task").iterdir():
                todo += [int(c) for c in (task / "children").read_text().split()]
        except (OSError, ValueError, IndexError):
            continue
    return total / 2**20


def guarded(command: list[str], limit_mb: float, every: float = 2.0, log: Path | None = None) -> dict[str, float | int | bool]:
    """Runs a command, looks at its memory again and again, and ends it with all its children beyond the limit.

    Returns its exit code (137 if it was ended), the highest memory seen, and the seconds it took.
    """
    began, peak, ended = time.monotonic(), 0.0, False
    with log.open("wb") if log else open(os.devnull, "wb") as out:
        child = subprocess.Popen(command, stdout=out, stderr=subprocess.STDOUT, start_new_session=True)
        while True:
            try:
                child.wait(every)
                break
            except subprocess.TimeoutExpired:
                peak = max(peak, resident_mb(child.pid))
                if peak > limit_mb:
                    ended = True
                    os.killpg(child.pid, signal.SIGKILL)
                    child.wait()
                    break
    return {"code": 137 if ended else child.returncode, "peak_mb": round(peak, 1), "seconds": round(time.monotonic() - began, 2), "ended": ended}


def health(checks: dict[str, Callable[[], bool | None]]) -> tuple[list[str], Counter]:
    """A line a check, and how many passed, warned (none could be told) and failed; a check that raises has failed."""
    lines, counts = [], Counter()
    for name, check in checks.items():
        try:
            told = check()
            verdict, why = ("warn" if told is None else "pass" if told else "fail"), ""
        except Exception as e:
            verdict, why = "fail", f" ({type(e).__name__}: {e})"
        counts[verdict] += 1
        lines.append(f"{verdict} {name}{why}")
    return lines, counts


def wait_for(state: Callable[[], str], ends: Iterable[str] = ("done", "failed", "interrupted"), every: float = 2.0, most: float = 3600.0) -> str:
    """The state of a job once it has ended, asked for again and again; a job that takes too long is an error."""
    ends, until = tuple(ends), time.monotonic() + most
    while (now := state()) not in ends:
        if time.monotonic() > until:
            raise TimeoutError(f"still {now}")
        time.sleep(every)
    return now
