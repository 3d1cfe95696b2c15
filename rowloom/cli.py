"""``python -m rowloom.cli create_table [--binary] [--exact] [--drop-last] SCHEMA CSV TABLE`` and
``extract_table [--binary] [--parts] TABLE CSV``.

--binary: the table is one interchange file, not a Parquet folder. --exact: the exact CSV tokenizer. --drop-last: as it,
and the last field of a file without final line break is not taken. --parts: a folder of ordered part files."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from rowloom.plans.pipeline import create_table, extract_table

# Fixed value: exit status for a wrong number of arguments.
BAD_USAGE = 111
COMMANDS = {"create_table": (create_table, 3, {"--binary": {"binary": True}, "--exact": {"exact": True}, "--drop-last": {"exact": True, "final": "drop"}}),
            "extract_table": (extract_table, 2, {"--binary": {"binary": True}, "--parts": {"parts": True}})}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in COMMANDS:
        return BAD_USAGE
    run, wanted, flags = COMMANDS[argv[0]]
    how: dict[str, object] = {}
    for a in argv[1:]:
        how |= flags.get(a, {})
    places = [a for a in argv[1:] if a not in flags]
    if len(places) != wanted:
        return BAD_USAGE
    run(SparkSession.builder.appName(argv[0]).getOrCreate(), *places, **how)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
