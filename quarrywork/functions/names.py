"""Column expressions over names: module specifiers, packages, and urls of repositories, people and commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import characters as C
from . import values as V

# --- packages ------------------------------------------------------------------------------------------------------------


def _head(text: Column, mark: str = "/") -> Column:
    return F.substring_index(text, mark, 1)


def _is_name(text: Column) -> Column:
    """A part of a package name: characters that a url takes as they are, a letter or digit first."""
    return C.only(text, C.ALNUM + "-._~") & C.begins_with(text, C.ALNUM)


def node_builtin(specifier: Column) -> Column:
    """node:name of a module that comes with Node, with or without the prefix; else null."""
    bare = F.when(specifier.startswith("node:"), F.nullif(_head(F.substr(specifier, F.lit(6))), F.lit("")))
    return F.concat(F.lit("node:"), F.coalesce(bare, F.when(~specifier.startswith("node:") & _head(specifier).isin(*V.NODE), _head(specifier))))


def npm_package(specifier: Column) -> Column:
    """@scope/name or name of a bare specifier; null where it cannot name a package (paths, aliases, subpath imports)."""
    first, second = _head(specifier), F.split_part(specifier, F.lit("/"), F.lit(2))
    scoped = F.when(_is_name(F.substr(first, F.lit(2))) & _is_name(second), F.concat_ws("/", first, second))
    return F.when(first.startswith("@"), scoped).otherwise(F.when(_is_name(first), first))


def npm_subpath(specifier: Column) -> Column:
    return F.substr(specifier, F.length(npm_package(specifier)) + 2)


def protocol_name(specifier: Column) -> Column:
    """What a specifier with a scheme names: the host of a url, the package of npm: and jsr: without its version, else scheme:first part; null without a scheme."""
    scheme, rest = F.coalesce(F.lower(C.scheme(specifier)), F.lit("")), F.substr(specifier, F.instr(specifier, ":") + 1)
    host = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(rest, r"^//([^/?#]*)", 1), "^.*@", "")), F.lit(""))
    # the name is the first part, the second below a scope; its version follows an at sign
    named_at = F.when(rest.startswith("@"), 1).otherwise(0)
    unversioned = F.array_join(F.transform(F.split(rest, "/"), lambda part, i: F.when((i == named_at) & ~part.startswith("@"), _head(part, "@")).otherwise(part)), "/")
    other = F.when(_head(rest) == "", scheme).otherwise(F.concat_ws(":", scheme, _head(rest)))
    named = F.when(scheme.isin("http", "https"), host).when(scheme == "npm", npm_package(unversioned)).when(scheme == "jsr", F.concat(F.lit("jsr:"), npm_package(unversioned)))
    return F.when(scheme == "", None).when(scheme.isin("http", "https", "npm", "jsr"), named).otherwise(other)


def external_package(specifier: Column) -> Column:
    """The outside package that a bare ECMAScript specifier names; null where it names none."""
    own = specifier.rlike(r"^[./#]") | (specifier == "")
    return F.when(own, None).when(specifier.startswith("node:"), node_builtin(specifier)).otherwise(F.coalesce(protocol_name(specifier), node_builtin(specifier), npm_package(specifier)))


def go_module(path: Column) -> Column:
    """The module of a Go import path by the conventions of its host; a major version belongs to it. Paths of the standard library stay whole."""
    parts = F.split(path, "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    n = F.when(first.isin(*V.GO_HOSTS) | ((first == "golang.org") & F.coalesce(second == "x", F.lit(False))), 3).otherwise(2)
    n = n + F.coalesce(F.get(parts, n).rlike("^v[0-9]+$"), F.lit(False)).cast("int")
    return F.when(~first.contains("."), path).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/"))


def external_module(specifier: Column, language: Column) -> Column:
    """The outside module that a specifier names, by language (as parser_language has it)."""
    rust = F.regexp_extract(F.regexp_replace(specifier, "^::", ""), r"^(?:r#)?(\w+)", 1)
    return (
        F.when(language.isin("typescript", "tsx", "javascript"), external_package(specifier)).when(language == "go", go_module(specifier))
        .when(language == "java", F.array_join(F.slice(F.split(specifier, r"\."), 1, 2), ".")).when(language == "rust", F.when(rust.isin(*V.RUST_STANDARD), "std").otherwise(rust))
        .when(language == "python", _head(specifier, "."))
    )


def map_use_tree(tree: Column) -> Column:
    """The flat paths of a Rust use tree: `a::{b, c::{d, self}}` is a::b, a::c::d, a::c. Aliases go; the innermost group is written out first, as often as there are groups."""
    flat = F.regexp_replace(F.regexp_replace(tree, r"\s+as\s+\w+", ""), r"[\s;]+", "")
    group = r"^(.*?)([^{},]*)\{([^{}]*)\}(.*)$"

    def write_out(at: Column, _: Column) -> Column:
        before, prefix, inner, after = (F.regexp_extract(at, group, i) for i in (1, 2, 3, 4))
        items = F.filter(F.split(inner, ","), lambda x: x != "")
        paths = F.transform(items, lambda x: F.when(x == "self", F.regexp_replace(prefix, "::$", "")).otherwise(F.concat(prefix, x)))
        return F.when(at.rlike(group), F.concat(before, F.array_join(paths, ","), after)).otherwise(at)

    groups = F.length(flat) - F.length(F.replace(flat, F.lit("{"), F.lit("")))
    steps = F.when(groups > 0, F.sequence(F.lit(1), groups)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.split(F.aggregate(steps, flat, write_out), ","), lambda x: x != "")


# --- urls ----------------------------------------------------------------------------------------------------------------


def classify_repo_url(url: Column, host: str = "github.com") -> Column:
    """struct(reason, owner, repo, ref, path) of what someone has typed; reason: ok, empty, not-github, missing-repo, invalid-owner or invalid-repo.

    Urls of the host with or without a scheme, git@host: addresses and plain owner/name are understood. ref and path come from /tree/, /blob/ and /commit/.
    """
    name = host.replace(".", r"\.")
    typed = F.trim(url)
    has_scheme = C.scheme(typed).isNotNull() & F.substr(typed, F.instr(typed, ":") + 1).startswith("//")
    is_url = has_scheme | typed.rlike(rf"(?i)^(www\.)?{name}/")
    rest = F.when(has_scheme, F.regexp_replace(typed, r"^[^:]*://", "")).otherwise(typed)
    web = ~has_scheme | F.lower(F.substring_index(typed, ":", 1)).isin("http", "https")
    on_host = web & F.regexp_extract(rest, "^[^/?#]*", 0).rlike(rf"(?i)^(www\.)?{name}(:(443|80)?)?$")
    ssh = F.regexp_extract(typed, rf"(?i)^git@{name}:(.+)$", 1)
    # owner/name: two parts, the first without a blank or a colon, the second beginning with neither
    part = lambda i: F.split_part(typed, F.lit("/"), F.lit(i))
    clean = lambda x: (x != "") & ~C.blank(x) & ~x.contains(":")
    plain = clean(part(1)) & clean(C.first(part(2))) & ~typed.contains("://")
    where = F.when(ssh != "", ssh).when(is_url, F.when(on_host, F.regexp_replace(rest, "^[^/?#]*", ""))).when(plain, typed)
    encoded = F.filter(F.split(F.regexp_extract(where, "^[^?#]*", 0), "/"), lambda x: x != "")
    parts = F.transform(encoded, lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    return F.when(url.isNotNull(), let(F.struct(typed.alias("typed"), parts.alias("parts")), lambda x: _judged(x["typed"], x["parts"])))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _judged(typed: Column, parts: Column) -> Column:
    """What the parts of an address come to; they are null where it is none of the host's."""
    broken = parts.isNull() | F.exists(parts, lambda x: x.isNull())
    owner, typed_repo, kind = (F.get(parts, F.lit(i)) for i in range(3))
    repo = F.regexp_replace(typed_repo, r"(?i)\.git$", "")
    good_owner = C.only(owner, C.ALNUM + "-") & ~(owner.startswith("-") | owner.endswith("-") | owner.contains("--")) & (F.length(owner) <= 39) & ~F.lower(owner).isin(*V.RESERVED_OWNERS)
    good_repo = C.only(repo, C.ALNUM + "-_.") & F.length(repo).between(1, 100) & ~repo.isin(".", "..") & ~F.lower(repo).endswith(".git")
    reason = (
        F.when(typed == "", "empty").when((F.length(typed) > 2048) | broken | (F.size(parts) == 0), "not-github").when(F.size(parts) == 1, "missing-repo")
        .when(~good_owner, "invalid-owner").when(~good_repo, "invalid-repo").otherwise("ok")
    )
    named, below = F.get(parts, F.lit(3)), F.slice(parts, F.lit(5), F.greatest(F.lit(0), F.size(parts) - 4))
    fine_ref = C.only(named, C.ALNUM + "-_./") & (F.length(named) <= 200) & ~(named.contains("..") | named.contains("//") | named.startswith("/") | named.endswith("/") | named.endswith(".lock"))
    fine_path = (F.size(below) > 0) & ~F.arrays_overlap(below, F.array(F.lit("."), F.lit("..")))

    def shown(reason: Column) -> Column:
        ok = reason == "ok"
        ref = F.when(ok & kind.isin("tree", "blob", "commit") & fine_ref, named)
        return F.struct(reason.alias("reason"), F.when(ok, owner).alias("owner"), F.when(ok, repo).alias("repo"), ref.alias("ref"), F.when(ref.isNotNull() & fine_path, F.array_join(below, "/")).alias("path"))

    return let(reason, shown)


def _encoded(text: Column) -> Column:
    """Percent-encoded, spaces too."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def safe_avatar(url: Column, prefix: str = "https://avatars.githubusercontent.com/") -> Column:
    return F.when(url.startswith(prefix), url)


def profile_url(login: Column, site: str = "https://github.com") -> Column:
    bot = F.regexp_extract(login, r"^(.+)\[bot\]$", 1)
    return F.when(bot != "", F.concat(F.lit(f"{site}/apps/"), _encoded(bot))).otherwise(F.concat(F.lit(f"{site}/"), _encoded(login)))


def commit_url(url: Column, repository_url: Column, sha: Column) -> Column:
    """The url given, if it is on the repository's own secure host; else one made of the repository's."""
    origin = F.regexp_extract(repository_url, r"^(https://[^/?#]+)", 1)
    own = (origin != "") & url.startswith(F.concat(origin, F.lit("/")))
    return F.when(F.coalesce(own, F.lit(False)), url).otherwise(F.concat(repository_url, F.lit("/commit/"), _encoded(sha)))
