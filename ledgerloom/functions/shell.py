"""What a shell command line runs: its words, executable, signature and kind, all as expressions.

Patterns that know quotes cut a line into words and a word into its parts, of which each loses its own quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE, _SINGLE = r"""\"(?:\\.|[^\"\\])*(?:\"|\\?\z)""", r"""'[^']*(?:'|\z)"""
_WORD = rf"""(?sU)(?:{_DOUBLE}|{_SINGLE}|[^\s\"'])+"""
_PART = rf"""(?s){_DOUBLE}|{_SINGLE}|[^\"']+"""
#: Shells whose -lc argument is the command, and words that only stand before one.
SHELLS, BEFORE = ("bash", "sh", "zsh", "fish"), ("rtk", "env", "command", "xcrun")
#: Kinds of commands in the order in which they are tried, as patterns over the words, each between commas.
KINDS = (
    ("build", r"^,(?:npm|yarn|pnpm),(?:run,)?(?:build|build:[^,]*|[^,]*:build),"),
    ("test", r"^,(?:npm|yarn|pnpm),(?:test,|run,[^,]*test)"),
    ("typecheck", r"^,(?:npm|yarn|pnpm),run,typecheck,"),
    ("dependency", r"^,(?:npm|yarn|pnpm),(?:install|add|ci),"),
    ("package", r"^,(?:npm|yarn|pnpm),(?:pack|publish|version),"),
    ("dev_server", r"^,(?:npm|yarn|pnpm),run,(?:serve,|start,|[^,]*dev)"),
    ("syntax_check", r",node,--check,"),
    ("node_eval", r"^,node,(?:--input-type=module,)?-e,"),
    ("node_cli", r"^,node,(?:.*)(?:query|analyze|report)"),
    ("git_status", r"^,git,status,"),
    ("git_remote", r",git,(?:push|pull|fetch|clone),"),
    ("git_local", r",git,(?:add|commit|branch|config|remote|restore),"),
    ("http", r",(?:curl|wget),"),
    ("process", r"^,(?:ps|pgrep|pkill|kill|lsof),"),
    ("terminal", r"^,tmux,"),
    ("browser_control", r"^,(?:open|osascript),"),
    ("file_mutation", r"^,(?:rm|mkdir|touch|chmod|cp|mv),"),
    ("shell_inspect", r"^,(?:pwd|ls|test),"),
)
ASSIGNMENT = "^[A-Z_][A-Z0-9_]*="


def _without_quotes(part: Column) -> Column:
    double = F.regexp_replace(F.regexp_extract(part, r"""(?s)^\"((?:\\.|[^\"\\])*)""", 1), r"(?s)\\(.)", "$1")
    return F.when(part.startswith('"'), double).when(part.startswith("'"), F.regexp_extract(part, "(?s)^'([^']*)", 1)).otherwise(part)


def words(line: Column) -> Column:
    """Words between blanks; quotes of either kind hold blanks together and go, a backslash takes the next character
    inside double quotes. An open quote reaches to the end. Empty words are none."""
    whole = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(_WORD), F.lit(0))
    plain = F.transform(whole, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_PART), F.lit(0)), _without_quotes), ""))
    return F.filter(plain, lambda w: w != "")


def run(found: Column) -> Column:
    """The words of what is run in the end: behind a shell's -lc, and behind words that only stand before a command."""
    n, first = F.size(found), F.array_position(F.transform(found, lambda w: w.isin(*BEFORE)), False)
    skip = F.greatest(F.least(F.when(first == 0, n).otherwise(first - 1), n - 1), F.lit(0)).cast("int")
    rest = F.slice(found, skip + 1, F.greatest(n, F.lit(1)))
    shell = (F.size(rest) >= 3) & F.get(rest, F.lit(0)).isin(*SHELLS) & (F.get(rest, F.lit(1)) == "-lc")
    return F.when(shell, words(F.array_join(F.slice(rest, 3, F.greatest(n, F.lit(1))), " "))).otherwise(rest)


def cut(line: Column) -> Column:
    """struct(words, run) of a command line."""
    return F.struct(words(F.trim(line)).alias("words"), run(words(line)).alias("run"))


def _name(word: Column) -> Column:
    return F.substring_index(word, "/", -1)


def executable(run: Column) -> Column:
    """The name of the first word that sets no variable."""
    return F.coalesce(_name(F.get(F.filter(run, lambda w: ~w.rlike(ASSIGNMENT)), F.lit(0))), F.lit("unknown"))


def signature(run: Column) -> Column:
    """The first word's name and the first later word that is neither an option nor a variable."""
    first = _name(F.get(run, F.lit(0)))
    second = F.get(F.filter(F.slice(run, 2, 1 << 30), lambda w: ~w.startswith("-") & ~w.rlike(ASSIGNMENT)), F.lit(0))
    return F.when(F.size(run) == 0, "unknown").otherwise(F.concat_ws(" ", first, second))


def kind(line: Column, found: Column) -> Column:
    """The first of KINDS that fits; a line with several commands that fits none is compound."""
    marked = F.concat(F.lit(","), F.array_join(F.transform(found, lambda w: F.replace(F.regexp_replace(w, "[;&|]+$", ""), F.lit(","), F.lit(" "))), ","), F.lit(","))
    out = F.when(line.rlike("[;&|]"), "compound").otherwise("unknown")
    for name, pattern in reversed(KINDS):
        out = F.when(marked.rlike(pattern), name).otherwise(out)
    return out
