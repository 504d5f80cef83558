"""``python -m planspark``: hardware, settings, and plans of captures."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from pathlib import Path

from planspark.plans import config
from planspark.sources import files, sinks


def hardware() -> dict[str, object]:
    """Memory and kind of this machine; graphics memory is not probed."""
    ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30 if hasattr(os, "sysconf") else 0.0
    return {"os": platform.system(), "arch": platform.machine(), "ram_gb": round(ram, 1), "apple": platform.system() == "Darwin" and platform.machine() == "arm64", "vram_gb": 0.0}


def auto_profile(machine: dict[str, object]) -> str:
    """The strongest profile that the machine holds."""
    if machine["vram_gb"] >= 11:
        return "cuda-24gb" if machine["vram_gb"] >= 22 else "cuda-16gb"
    if machine["apple"] and machine["ram_gb"] >= 15:
        return "mac-32gb" if machine["ram_gb"] >= 30 else "mac-16gb"
    return "lite"


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("planspark").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def planned(path: Path, out: Path, settings: dict, text: str = "", scale: float = 256 / 1920, res: float = 0.02) -> Path:
    """Plan of a capture; tiers that need models enter by their recorded views (``views`` table in the capture)."""
    from planspark.plans import tiers

    found = files.resolve(path, out)
    tier = files.tier_of(found)
    spark = session()
    if tier == "lidar":
        plan = tiers.scan_plan(spark, str(found), settings, scale, res)
    else:
        folder = (found if found.is_dir() else found.parent) / "views"
        if not folder.exists():
            raise FileNotFoundError(f"{tier} captures need recorded views at {folder}")
        plan = tiers.view_plan(spark.read.parquet(str(folder)), tier, str(found), res=res)
    plan["capture"]["config_digest"] = config.digest(settings)
    return sinks.write_plan(plan, out / found.resolve().name, text)


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planspark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("hw")
    for verb in ("config", "run"):
        p = verbs.add_parser(verb)
        p.add_argument("-p", "--profile", default="auto")
        p.add_argument("-c", "--config", type=Path)
        p.add_argument("-s", "--set", action="append", default=[])
        if verb == "run":
            p.add_argument("capture", type=Path)
            p.add_argument("-o", "--out", type=Path, default=Path("out"))
    verbs.add_parser("inspect").add_argument("capture", type=Path)
    serving = verbs.add_parser("serve")
    serving.add_argument("--host", default="127.0.0.1")
    serving.add_argument("--port", type=int, default=8765)
    serving.add_argument("--folder", type=Path, default=Path("runs"))
    given = parser.parse_args(words)
    machine = hardware()
    try:
        if given.verb == "hw":
            print(json.dumps(machine | {"profile": auto_profile(machine), "profiles": sorted(config.PROFILES)}))
        elif given.verb == "inspect":
            print(json.dumps({"tier": files.tier_of(files.resolve(given.capture, given.capture.parent))}))
        elif given.verb == "serve":
            from planspark.server import serve

            serve(given.host, given.port, given.folder)
        else:
            name = auto_profile(machine) if given.profile == "auto" else given.profile
            settings = config.load(name, given.config.read_text() if given.config else "", tuple(given.set))
            text = config.dump(settings, name, machine)
            if given.verb == "config":
                print(text, end="")
            else:
                path = planned(given.capture, given.out, settings, text)
                print("\n".join([*sinks.summary(json.loads(path.read_text())), f"wrote {path}"]))
    except (config.SettingError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
