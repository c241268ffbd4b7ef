"""What a tool call of an agent is after: structural searches, test runs, edits of source files."""

from __future__ import annotations

from pyspark.sql import Column

# Patterns over command lines, search patterns and paths.
GREP_COMMAND = r"(^|\s)(rg|grep|ack|ag)(\s|$)"
STRUCTURAL = r"(^|\s)(fn |impl |trait |class |interface |enum |struct |def |async def |function |extends |implements |import |from |use |require\()"
TEST_COMMAND = r"(^|\s)(pytest|jest|vitest|cargo\s+test|npm\s+test|yarn\s+test|pnpm\s+test)(\s|$)"
SOURCE_FILE = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|rs)$"


def is_structural_search(pattern: Column) -> Column:
    return pattern.rlike(STRUCTURAL)


def is_structural_command(command: Column) -> Column:
    """A search command whose pattern asks for declarations or imports."""
    quoted = r"(fn |impl |trait |class |interface |enum |struct |def |async def |function |extends |implements |^import |^from |^use )"
    return command.rlike(GREP_COMMAND) & command.rlike(quoted)


def is_test_run(command: Column) -> Column:
    return command.rlike(TEST_COMMAND)


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE)
