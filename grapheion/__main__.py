"""python -m grapheion build|update|status|watch|visualize|config [NAME VALUE] [--repo DIR] [--out FILE]"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from grapheion import tools
from grapheion.functions import text as tx
from grapheion.sources import extract, files, git, store

DEBOUNCE_MS = 300


def stamps(root: str) -> dict[str, tuple[float, int]]:
    """(time, size) of the source files that git tracks or the folder holds."""
    found = {}
    for p in files.listed(root, git.tracked(root)):
        if extract.language_of_path(p):
            try:
                s = os.stat(os.path.join(root, p))
            except OSError:  # gone between listing and look
                continue
            found[p] = s.st_mtime, s.st_size
    return found


def watch(repo: tools.Repository, rounds: int | None = None, pause: float = DEBOUNCE_MS / 1000) -> int:
    """Update the graph when files change, at most once a pause; returns the updates made in ``rounds``."""
    seen, made = stamps(repo.root), 0
    while rounds is None or rounds > 0:
        time.sleep(pause)
        now = stamps(repo.root)
        changed = sorted(p for p in now.keys() | seen.keys() if now.get(p) != seen.get(p))
        if changed:
            repo.update(changed)
            made += 1
        seen = now
        rounds = None if rounds is None else rounds - 1
    return made


def config(root: str, name: str | None = None, value: str | None = None) -> dict[str, str]:
    """Set one setting of the store's config.json if asked; shows all, the key masked."""
    if name is not None:
        if name not in store.SETTINGS or value is None:
            raise ValueError(f"settings are {', '.join(store.SETTINGS)}, each with a value")
        store.set_setting(root, name, value)
    return {k: tx.mask_key(v) if k == "api_key" else v for k, v in store.settings(root).items()}


def main() -> None:
    p = argparse.ArgumentParser(prog="grapheion")
    p.add_argument("command", choices=["build", "update", "status", "watch", "visualize", "config"])
    p.add_argument("setting", nargs="*")
    p.add_argument("--repo")
    p.add_argument("--out", default="graph.html")
    args = p.parse_args()
    if args.command == "config":
        print(json.dumps(config(store.find_root(args.repo), *args.setting[:2]), indent=2))
        return
    repo = tools.Repository(SparkSession.builder.appName("grapheion").getOrCreate(), args.repo)
    if args.command == "visualize":
        with open(args.out, "w", encoding="utf8") as f:
            f.write(store.html(repo.store.read()))
        print(args.out)
    elif args.command == "watch":
        watch(repo, pause=int(store.settings(repo.root).get("watch_debounce_ms", DEBOUNCE_MS)) / 1000)
    else:
        found = tools.list_graph_stats(repo) if args.command == "status" else tools.build_or_update_graph(repo, args.command == "build")
        print(json.dumps(found, indent=2, default=str))


if __name__ == "__main__":
    main()
