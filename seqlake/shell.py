"""A command loop over a store: ``python -m seqlake.shell DIRECTORY``.

put KEY VALUE, del KEY, get KEY, scan START END, begin, commit, rollback, flush (or save), stats, compact, quit. Words are
parted by white space, so keys and values that hold some need the API. The end of input quits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from seqlake.store import Store

WORDS = {"put": 2, "del": 1, "get": 1, "scan": 2, "begin": 0, "commit": 0, "rollback": 0, "flush": 0, "save": 0, "stats": 0, "compact": 0, "quit": 0}


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """What each command of ``lines`` prints."""
    for line in lines:
        command, *words = line.split() or [""]
        if not command:
            continue
        if WORDS.get(command) != len(words):
            yield __doc__.split("\n\n")[1]
            continue
        try:
            if command == "get":
                row = store.get(*words).first()
                yield f"{row['value']}{' (from segment)' if row['origin'] == 'segment' else ''}" if row else "not found"
            elif command == "scan":
                rows = [f"{r['key']}:{r['value']}" for r in store.scan(*words).toLocalIterator()]
                yield from rows or ["no keys in this range"]
            elif command == "stats":
                yield from (f"level {r['level']}: {r['files']} files, {r['bytes']} / {r['limit_bytes']} bytes" for r in store.stats().orderBy("level").collect())
            else:
                {"put": store.put, "del": store.delete, "begin": store.begin, "commit": store.commit, "rollback": store.rollback, "flush": store.flush, "save": store.flush, "compact": store.compact, "quit": store.close}[command](*words)
                yield "ok"
                if command == "quit":
                    return
        except ValueError as problem:
            yield f"refused: {problem}"
    store.close()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    for out in run(Store(SparkSession.builder.appName("seqlake").getOrCreate(), sys.argv[1]), sys.stdin):
        print(out, flush=True)
