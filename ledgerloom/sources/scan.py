"""Reading everything that is there: the catalog of tools, where their logs lie, and a scan that no broken log stops."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import merge
from ledgerloom.session import cut
from ledgerloom.sources.readers import READERS, Reader, limit_readings
from ledgerloom.streaming.ledger import merged


@dataclass(frozen=True)
class Source:
    """paths: where logs lie below the home folder; setting: an environment variable that names another place, with what is
    appended to it."""

    key: str
    label: str
    paths: tuple[str, ...]
    setting: str | None = None
    suffix: str = ""
    limits: str | None = None


#: The tools that are known, in the order in which pages show them, and where they keep their logs.
CATALOG = (
    Source("claude", "Claude Code", (".claude/projects",), limits="live"),
    Source("codex", "Codex", (".codex/sessions",), "CODEX_HOME", "sessions", "live"),
    Source("copilot", "GitHub Copilot", (".copilot/session-store.db",), "COPILOT_HOME", "session-store.db", "live"),
    Source("gemini", "Gemini CLI", (".gemini/tmp",), "GEMINI_CLI_HOME", "tmp"),
    Source("hermes", "Hermes", (".hermes/state.db",), "HERMES_HOME", "state.db"),
    Source("grok", "Grok Build", (".grok/sessions",), "GROK_HOME", "sessions", "live"),
    Source("antigravity", "Google Antigravity", (".gemini/antigravity/conversations", ".gemini/antigravity-ide/conversations", ".gemini/antigravity-cli/conversations"), limits="live"),
    Source("goose", "Goose", (".local/share/goose/sessions",), "GOOSE_PATH_ROOT", "data/sessions"),
    Source("opencode", "OpenCode", (".local/share/opencode/opencode.db",), "OPENCODE_DB"),
    Source("kilo", "Kilo CLI", (".local/share/kilo/kilo.db",), "KILO_DB"),
    Source("zed", "Zed", (".local/share/zed/threads/threads.db",), "XDG_DATA_HOME", "zed/threads/threads.db"),
    Source("cline", "Cline", (".config/Code/User/globalStorage/saoudrizwan.claude-dev/tasks", ".cline/data"), "CLINE_DATA_DIR"),
    Source("pi", "pi", (".pi/agent/sessions",), "PI_CODING_AGENT_SESSION_DIR"),
    Source("omp", "Oh My Pi", (".omp/agent/sessions",), "OMP_SESSION_DIR"),
    Source("workbuddy", "WorkBuddy", (".workbuddy/projects",)),
    Source("codebuddy", "CodeBuddy", (".codebuddy/projects",)),
    Source("qoder", "Qoder", (".config/QoderCN/SharedClientCache/cache/db/local.db", ".config/Qoder/SharedClientCache/cache/db/local.db")),
)


def catalog(spark: SparkSession) -> DataFrame:
    """(place, key, label, limits) of the catalog."""
    return spark.createDataFrame([(i, s.key, s.label, s.limits) for i, s in enumerate(CATALOG)], "place int, key string, label string, limits string")


def roots(source: Source, home: str, environment: dict[str, str] | None = None, overlay: str | None = None) -> list[str]:
    """Where a tool's logs are looked for: an overlay that the caller gives, else what the environment names, else the usual
    places. Blank and relative places don't count, ~ is the home folder, and no place comes twice."""
    environment = os.environ if environment is None else environment
    named = environment.get(source.setting, "") if source.setting else ""

    def visible(path: str) -> str | None:
        path = path.strip()
        path = home if path == "~" else f"{home}/{path[2:]}" if path.startswith("~/") else path
        return path if path.startswith("/") else None

    given = visible(overlay or "")
    if given is None and (place := visible(named)) is not None:
        given = f"{place}/{source.suffix}" if source.suffix else place
    found = [given] if given else [f"{home}/{p}" for p in source.paths]
    tidy = lambda p: os.path.normpath(str(PurePosixPath(p)))
    return list(dict.fromkeys(map(tidy, found)))


#: Sources whose records come again with more output, each column by its rule; of the others the last one read stays.
GROWING = ("claude", "pi", "omp", "workbuddy", "codebuddy")


def run(spark: SparkSession, home: str, environment: dict[str, str] | None = None, overlays: dict[str, str] | None = None, readers: dict[str, Reader] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(ledger, status): the merged records of all tools, and (source, records, error) of each tool of the catalog. A tool whose
    logs can't be read says so in its error and stops no other."""
    readers = READERS if readers is None else readers
    out, said = None, []
    for source in CATALOG:
        read = readers.get(source.key)
        if read is None:
            said.append((source.key, 0, None))  # the caller leaves it out
            continue
        try:
            rows = read(spark, roots(source, home, environment, (overlays or {}).get(source.key)))
            if source.key in GROWING:
                rows = merged(rows).drop("seq")
            elif "seq" in rows.columns:
                rows = merge.replace(rows)
            rows = cut(rows)  # logs are parsed once
            found = rows.count()
        except (PySparkException, OSError, ValueError) as wrong:
            said.append((source.key, 0, str(wrong).splitlines()[0][:200]))
            continue
        said.append((source.key, found, None))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame(said, "source string, records long, error string")


def readings(spark: SparkSession, home: str, environment: dict[str, str] | None = None, overlays: dict[str, str] | None = None, exports: list[str] = ()) -> DataFrame:
    """The limit readings of all tools' logs and of exports."""
    return limit_readings(spark, {s.key: roots(s, home, environment, (overlays or {}).get(s.key)) for s in CATALOG}, exports)


def changes(status: DataFrame) -> DataFrame:
    """What a scan changed, for those who wait for it: records that were read and tools that failed."""
    return status.agg(F.sum("records").alias("records"), F.count_if(F.col("error").isNotNull()).alias("failed"))
