"""Column functions over POSIX paths: language, tests, stems, prefixes, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each file suffix.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".txt": "text", ".toml": "config", ".yaml": "config", ".yml": "config", ".json": "config", ".cfg": "config", ".ini": "config",
    ".html": "template", ".jinja": "template", ".j2": "template", ".css": "style", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".sh": "shell", ".sql": "sql", ".tex": "latex",
}
#: Language of files known by their whole name.
WHOLE_NAMES = {"Makefile": "build", "Dockerfile": "build", "LICENSE": "text", "CHANGES": "text", "AUTHORS": "text"}
DOC_LANGUAGES = ("markdown", "rst", "text")
CODE_LANGUAGES = ("python", "javascript", "typescript", "c", "cpp", "java", "go", "rust", "ruby", "shell", "sql")
CONFIG_LANGUAGES = ("config", "build")
#: Directories and name endings of tests, and names of CI files.
TEST_DIRS = ("test", "tests", "testing", "__tests__", "spec")
TEST_ENDS = ("_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "_test.go")
CI_NAMES = (".pre-commit-config.yaml", "tox.ini", ".readthedocs.yaml", ".readthedocs.yml", "noxfile.py", ".coveragerc", "codecov.yml", ".gitlab-ci.yml")
#: Categories of file pairs, most useful first.
CATEGORIES = ("cross_language", "code_code", "config_code", "test_code", "test_test", "config_config", "ci", "other")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """Last suffix of the name, as pathlib has it: none for ``.x`` and ``x.``."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def language_of(path: Column) -> Column:
    """Language by lower-case suffix, else by whole name, else null."""
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs(LANGUAGES), F.lower(suffix(path))), F.try_element_at(pairs(WHOLE_NAMES), name(path)))


def is_test_path(path: Column) -> Column:
    low = F.lower(name(path))
    parts = F.split(path, "/")
    ends = low.startswith("test_")
    for e in TEST_ENDS:
        ends = ends | low.endswith(e)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, TEST_DIRS))) | ends


def tested_stem(path: Column) -> Column:
    """What a test is named after; null for a name without a test affix that doesn't start with ``test``."""
    s = stem(path)
    bare = F.regexp_extract(s, r"^(?:test_)?(.+?)(?:_test|\.test|\.spec)?$", 1)
    bare = F.when(F.length(bare) == 0, s).otherwise(bare)
    return F.when((bare != s) | s.startswith("test"), bare)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading parts."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(pairs, False)
    return F.when(at == 0, F.size(pairs)).otherwise(at - 1).cast("int")


def dir_id(path: Column) -> Column:
    return F.when(path.isin("", "."), F.lit("dir:.")).otherwise(F.concat(F.lit("dir:"), path))


def normalized(path: Column) -> Column:
    """``.`` and ``..`` resolved; above the top is the top."""
    step = lambda acc, x: (
        F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin(".", ""), acc).otherwise(F.array_append(acc, x))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, ``.`` last."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return above


def is_ci(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), ".github") | name(path).isin(*CI_NAMES)


def classify_pair(a: Column, lang_a: Column, test_a: Column, b: Column, lang_b: Column, test_b: Column) -> Column:
    """Category of a file pair; the first that fits."""
    code = (*CODE_LANGUAGES, "template", "style")
    conf_a, conf_b = (F.coalesce(x.isin(*CONFIG_LANGUAGES), F.lit(False)) for x in (lang_a, lang_b))
    code_a, code_b = (F.coalesce(x.isin(*code), F.lit(False)) for x in (lang_a, lang_b))
    both = code_a & code_b
    return (
        F.when(is_ci(a) & is_ci(b), "ci")
        .when(conf_a & conf_b, "config_config")
        .when((conf_a | conf_b) & (code_a | code_b), "config_code")
        .when(conf_a | conf_b, "other")
        .when(both & test_a & test_b, "test_test")
        .when(both & (test_a | test_b), "test_code")
        .when(both & (lang_a == lang_b), "code_code")
        .when(both, "cross_language")
        .when(is_ci(a) | is_ci(b), "ci")
        .otherwise("other")
    )
