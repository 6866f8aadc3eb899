"""Column expressions for review text: lines, paths, hunks, tokens. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends and blanks as Unicode text has them.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
BLANK = "[\\s\\u001c-\\u001f]"
# What marks files and accounts.
SOURCE_SUFFIXES = (".py", ".pyi", ".cfg", ".toml", ".ini")
DOC_SUFFIXES = (".md", ".markdown", ".mdx", ".rst", ".txt")
SKIP_DIRECTORIES = (".git", ".github/workflows/generated", ".mypy_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "site-packages", "third_party", "vendor")
LANGUAGES = {".py": "python", ".pyi": "python", ".md": "docs", ".rst": "docs", ".txt": "docs", ".mdx": "docs", ".markdown": "docs", ".toml": "config", ".cfg": "config", ".ini": "config"}
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "npm-shrinkwrap.json", "go.sum")
GENERATED_SUFFIXES = (".lock", ".min.js", ".min.css", ".map", ".snap")
VENDORED_DIRS = ("vendor", "node_modules", "third_party", "_vendor", "site-packages")
BOT_LOGINS = ("codecov", "coderabbitai", "dependabot", "pre-commit-ci", "sonarcloud", "sonarqubecloud")
AUTOMATED_REVIEWERS = ("kramlipi", "copilot")
ACKNOWLEDGEMENTS = ("lgtm", "+1", "nice", "thanks", "thank you", "done", "fixed", "ship it", "good catch", "looks good")
MIN_BODY_CHARS = 40


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty one after a final line end; none for an empty text."""
    lines = F.split(text, LINE_END)
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def file_kind(path: Column) -> Column:
    """source, doc, or null for a file that is not mined."""
    return F.when(suffix(path).isin(*SOURCE_SUFFIXES), "source").when(suffix(path).isin(*DOC_SUFFIXES), "doc")


def is_skipped_path(path: Column) -> Column:
    """Inside a vendored, generated or egg-info folder."""
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRECTORIES))) | F.exists(parts, lambda p: p.endswith(".egg-info"))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    end = suffix(F.coalesce(path, F.lit("")))
    return F.when(end == "", "none").otherwise(F.coalesce(F.element_at(known, end), F.lit("other")))


def url_number(url: Column) -> Column:
    """The number a URL ends in, else null."""
    tail = F.element_at(F.split(url, "/"), -1)
    return F.when(tail.rlike("^[0-9]{1,18}$"), tail.cast("long"))


def is_automated_login(login: Column) -> Column:
    low = F.lower(login)
    return low.endswith("[bot]") | low.isin(*BOT_LOGINS, *AUTOMATED_REVIEWERS)


def is_bot(login: Column, kind: Column, has_user: Column) -> Column:
    """No user, an account of type Bot, or a login of an automated reviewer."""
    return ~has_user | F.coalesce(kind == "Bot", F.lit(False)) | F.coalesce(is_automated_login(login), F.lit(False))


def nit_reason(body: Column) -> Column:
    """emoji_only, acknowledgement or short, tried in this order; null for a real remark."""
    said = strip(body)
    words = "|".join("\\Q" + a + "\\E" for a in ACKNOWLEDGEMENTS)
    rest = F.regexp_replace(said, f"(?iuU)\\A\\W*(?:{words})\\b\\W*", "")
    return (
        F.when(~said.rlike("(?U)\\w") & ~said.startswith("+1"), "emoji_only")
        .when((rest != said) & (F.length(strip(rest)) < MIN_BODY_CHARS), "acknowledgement")
        .when(F.length(said) < MIN_BODY_CHARS, "short")
    )


def before_state(hunk: Column) -> Column:
    """What the hunk's code was: heading, context and removed lines; empty if blank."""

    def old(line: Column) -> Column:
        heading = strip(F.regexp_replace(line, "^@@(.*?@@)?", ""))  # what follows the second @@, or the first if it is alone
        return (
            F.when(line.startswith("@@"), F.when(heading != "", heading))
            .when(line.startswith("+") | line.startswith("\\"), F.lit(None))
            .when(line.startswith("-") | line.startswith(" "), F.substring(line, 2, 1 << 30))
            .otherwise(line)
        )

    text = F.array_join(F.filter(F.transform(split_lines(hunk), old), lambda x: x.isNotNull()), "\n")
    return F.when(strip(text) == "", F.lit("")).otherwise(text)


def has_suggestion(body: Column) -> Column:
    return body.rlike("(?m)^```\\s*suggestion\\b")


def joined(*parts: Column) -> Column:
    """The parts that are not blank, stripped, with an empty line between."""
    stripped = F.array(*[strip(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.array_join(F.filter(stripped, lambda x: x != ""), "\n\n")


def after(text: Column, skipped: Column) -> Column:
    """The text from the character after the first `skipped` ones."""
    return text.substr(skipped + 1, F.greatest(F.length(text), F.lit(1)))


def body_only(text: Column, path: Column, hunk: Column) -> Column:
    """A comment unit's text without the path:line and hunk parts it may open with."""
    head = F.instr(text, "\n\n")
    has_head = (F.coalesce(path, F.lit("")) != "") & (head > 0) & text.startswith(F.concat(path, F.lit(":")))
    rest = F.when(F.coalesce(has_head, F.lit(False)), after(text, head + 1)).otherwise(text)
    code = strip(F.coalesce(hunk, F.lit("")))
    return F.when((code != "") & rest.startswith(F.concat(code, F.lit("\n\n"))), after(rest, F.length(code) + 2)).otherwise(rest)


#: Two parts of one identifier meet: lower and upper case, an acronym and a word, letters and digits, an inner underscore.
PARTS_MEET = "[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z0-9]_+[A-Za-z0-9]"


def tokens(text: Column) -> Column:
    """Identifiers, lower-cased without outer underscores, and their snake and camel parts when several."""
    camel = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"

    def parts(word: Column) -> Column:
        whole = F.array(F.btrim(F.lower(word), F.lit("_")))
        # most words are one part, and are not searched for more
        return F.when(word.rlike(PARTS_MEET), F.concat(whole, F.transform(F.regexp_extract_all(word, F.lit(camel), F.lit(0)), F.lower))).otherwise(whole)

    words = F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))
    return F.filter(F.flatten(F.transform(words, parts)), lambda x: x != "")


def file_skip_reason(path: Column, status: Column, changes: Column, patch: Column) -> Column:
    """Why a changed file is not reviewed; null if it is."""
    name, folders = basename(path), F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return (
        F.when(status == "removed", "deleted")
        .when((status == "renamed") & (F.coalesce(changes, F.lit(0)) == 0), "renamed without changes")
        .when(any_of(name.isin(*LOCKFILES), *[name.endswith(s) for s in GENERATED_SUFFIXES]), "lockfile or generated")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, VENDORED_DIRS))), "vendored")
        .when(F.coalesce(patch, F.lit("")) == "", "no patch: binary or too large")
    )


def path_weight(path: Column) -> Column:
    """0.5 for tests and docs, else 1."""
    folder = lambda names: path.rlike(f"(^|/)({names})/")
    name = basename(path)
    test = name.startswith("test_") | name.rlike("(_test\\.py|\\.test\\.ts|\\.spec\\.ts)$") | folder("tests|test|__tests__")
    doc = name.rlike("\\.(md|rst|txt)$") | folder("docs")
    return F.when(test | doc, 0.5).otherwise(1.0)


def pull_skip_reason(draft: Column, author: Column) -> Column:
    return F.when(draft, "draft").when(author.endswith("[bot]"), "bot")


def seed_source(repo: Column, branch: Column, testbed: str) -> Column:
    """(repo, number) that the branch seed/<owner>__<name>/<number>/head stands for, in the testbed repository only."""
    pattern = "^seed/([\\w.-]+)__([\\w.-]+)/([1-9][0-9]{0,8})/head$"
    part = lambda i: F.regexp_extract(branch, pattern, i)
    return F.when(
        (F.lower(repo) == testbed.lower()) & branch.rlike(pattern),
        F.struct(F.concat(part(1), F.lit("/"), part(2)).alias("repo"), part(3).cast("int").alias("number")),
    )


def clipped(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3).cast("long")
