"""Language versions: feature support, names and detection by rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The versions of each language, oldest first, with their written names.
FAMILIES = {
    "c": ("C89", "C99", "C11", "C17", "C23"),
    "cpp": ("Cpp98", "Cpp03", "Cpp11", "Cpp14", "Cpp17", "Cpp20", "Cpp23"),
    "java": ("Java8", "Java11", "Java17", "Java21"),
    "python": ("Python2", "Python3", "Python38", "Python39", "Python310", "Python311", "Python312"),
    "javascript": ("ES5", "ES6", "ES2016", "ES2017", "ES2018", "ES2019", "ES2020", "ES2021", "ES2022", "ES2023"),
    "go": ("Go118", "Go119", "Go120", "Go121"),
    "csharp": ("DotNetFramework48", "DotNetCore31", "DotNet5", "DotNet6", "DotNet7", "DotNet8"),
}
NAMES = {
    "Cpp98": "C++98", "Cpp03": "C++03", "Cpp11": "C++11", "Cpp14": "C++14", "Cpp17": "C++17", "Cpp20": "C++20", "Cpp23": "C++23",
    "Java8": "Java 8", "Java11": "Java 11", "Java17": "Java 17", "Java21": "Java 21",
    "Python2": "Python 2", "Python3": "Python 3", "Python38": "Python 3.8", "Python39": "Python 3.9", "Python310": "Python 3.10", "Python311": "Python 3.11", "Python312": "Python 3.12",
    "ES6": "ES6/ES2015", "Go118": "Go 1.18", "Go119": "Go 1.19", "Go120": "Go 1.20", "Go121": "Go 1.21",
    "DotNet5": ".NET 5", "DotNet6": ".NET 6", "DotNet7": ".NET 7", "DotNet8": ".NET 8", "DotNetFramework48": ".NET Framework 4.8", "DotNetCore31": ".NET Core 3.1",
    "Auto": "Auto-detect",
}

# The first version with a feature.
FEATURES = {
    ("cpp", "auto"): "Cpp11", ("cpp", "lambda"): "Cpp11", ("cpp", "nullptr"): "Cpp11", ("cpp", "override"): "Cpp11", ("cpp", "auto_return"): "Cpp14",
    ("cpp", "structured_bindings"): "Cpp17", ("cpp", "if_constexpr"): "Cpp17", ("cpp", "inline_variables"): "Cpp17",
    ("cpp", "concepts"): "Cpp20", ("cpp", "coroutines"): "Cpp20", ("cpp", "modules"): "Cpp20", ("cpp", "ranges"): "Cpp20", ("cpp", "spaceship"): "Cpp20",
    ("java", "lambda"): "Java8", ("java", "stream"): "Java8", ("java", "var"): "Java11", ("java", "sealed"): "Java17", ("java", "pattern_matching"): "Java17", ("java", "virtual_threads"): "Java21",
    ("python", "annotations"): "Python3", ("python", "walrus"): "Python38", ("python", "match"): "Python310", ("python", "exception_groups"): "Python311",
    ("javascript", "arrow_functions"): "ES6", ("javascript", "let_const"): "ES6", ("javascript", "template_literals"): "ES6", ("javascript", "async_await"): "ES2017",
    ("javascript", "optional_chaining"): "ES2020", ("javascript", "nullish_coalescing"): "ES2020",
    ("go", "generics"): "Go118",
}
#: The features for which a least version is given.
WITH_MINIMUM = frozenset((
    ("cpp", "auto"), ("cpp", "lambda"), ("cpp", "structured_bindings"), ("cpp", "concepts"), ("cpp", "coroutines"), ("cpp", "modules"),
    ("java", "lambda"), ("java", "var"), ("java", "sealed"), ("java", "virtual_threads"),
    ("python", "annotations"), ("python", "walrus"), ("python", "match"),
    ("javascript", "arrow_functions"), ("javascript", "async_await"), ("javascript", "optional_chaining"),
    ("go", "generics"),
))

# Fixed values.  A rule is a version, a confidence, groups of which each must have
# one word in the source, and words that must not be there; the first that holds counts.
CPP_RULES = (
    ("Cpp20", 0.95, (("co_await", "co_yield", "co_return"),), ()), ("Cpp20", 0.9, (("concept ", "requires "),), ()), ("Cpp20", 0.9, (("<=>",),), ()), ("Cpp20", 0.85, (("import ",),), ("#import",)),
    ("Cpp17", 0.9, (("if constexpr",),), ()), ("Cpp17", 0.8, (("[[nodiscard]]", "[[maybe_unused]]"),), ()), ("Cpp17", 0.8, (("std::optional", "std::variant", "std::any"),), ()),
    ("Cpp14", 0.7, (("auto ",), ("return",), ("->",)), ()), ("Cpp14", 0.6, (("'000", "'999"),), ()),
    ("Cpp11", 0.8, (("nullptr",),), ()), ("Cpp11", 0.8, (("override", "final"),), ()), ("Cpp11", 0.7, (("auto ",),), ("auto*",)), ("Cpp11", 0.8, (("= delete", "= default"),), ()), ("Cpp11", 0.8, (("constexpr",),), ()),
    ("Cpp11", 0.8, (("std::unique_ptr", "std::shared_ptr"),), ()), ("Cpp11", 0.7, (("[]",), ("](", "] (")), ()),
    ("C11", 0.7, (("_Static_assert",),), ()), ("C11", 0.7, (("_Alignas", "_Alignof"),), ()), ("C99", 0.6, (("restrict",),), ()), ("C99", 0.3, (("//",),), ("/*",)),
    ("Cpp98", 0.6, (("class ", "namespace ", "template<"),), ()), ("Cpp98", 0.4, (("#include <iostream>", "std::"),), ()),
    ("C89", 0.3, (), ()),
)
JAVA_RULES = (
    ("Java21", 0.9, (("Thread.startVirtualThread", "virtual Thread"),), ()),
    ("Java17", 0.9, (("sealed ", "permits "),), ()), ("Java17", 0.8, (("case ",), ("->",)), ("switch",)), ("Java17", 0.8, (('"""',),), ()),
    ("Java11", 0.8, (("var ",),), ("var[",)), ("Java11", 0.8, (("HttpClient.newHttpClient",),), ()),
    ("Java8", 0.7, (("->",), ("(", "::")), ()), ("Java8", 0.7, (("stream()", "Stream<"),), ()), ("Java8", 0.7, (("Optional<", "Optional."),), ()), ("Java8", 0.8, (("@FunctionalInterface",),), ()),
    ("Java8", 0.4, (), ()),
)
# Versions by what a flag or build file names; all of confidence 0.95.
STANDARDS = {
    "c++23": "Cpp23", "c++2b": "Cpp23", "c++20": "Cpp20", "c++2a": "Cpp20", "c++17": "Cpp17", "c++1z": "Cpp17", "c++14": "Cpp14", "c++1y": "Cpp14", "c++11": "Cpp11", "c++0x": "Cpp11", "c++03": "Cpp03", "c++98": "Cpp98",
    "c23": "C23", "c2x": "C23", "c17": "C17", "c18": "C17", "c11": "C11", "c99": "C99", "c89": "C89", "c90": "C89",
}
BUILDS = {"21": "Java21", "21.0": "Java21", "17": "Java17", "17.0": "Java17", "11": "Java11", "11.0": "Java11", "8": "Java8", "1.8": "Java8", "8.0": "Java8"}
NAMED = 0.95


def family(language: str) -> str:
    return "javascript" if language == "typescript" else language


def feature_table(spark: SparkSession) -> DataFrame:
    """``(language, feature, version, supported)`` over all families."""
    rows = [(lang, feature, v, known.index(v) >= known.index(first)) for (lang, feature), first in FEATURES.items() for known in (FAMILIES[lang],) for v in known]
    return spark.createDataFrame(rows, "language string, feature string, version string, supported boolean")


def minimum_for(language: str, feature: str) -> str | None:
    key = (family(language), feature)
    return FEATURES[key] if key in WITH_MINIMUM else None


def minimum_table(spark: SparkSession) -> DataFrame:
    """``(language, feature, version, name)``: the least version with a feature."""
    rows = [(lang, f, v, display(v)) for lang, f in sorted(WITH_MINIMUM) for v in (FEATURES[lang, f],)]
    rows += [("typescript", *r[1:]) for r in rows if r[0] == "javascript"]
    return spark.createDataFrame(rows, "language string, feature string, version string, name string")


def display(version: str) -> str:
    return NAMES.get(version, version)


def _found(version: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(confidence.cast("double").alias("confidence"), version.alias("version"), reason.alias("reason"))


def detect(source: Column, rules) -> Column:
    """``struct(confidence, version, reason)`` of the first rule that holds; the
    reason is the rule's first word found."""
    out = None
    for version, confidence, groups, without in reversed(rules):
        has = [F.when(F.contains(source, F.lit(w)), F.lit(w)) for w in (groups[0] if groups else ())]
        hit = _found(F.lit(version), F.lit(confidence), F.coalesce(*has, F.lit("")))
        holds = F.lit(True)
        for group in groups:
            some = F.lit(False)
            for w in group:
                some = some | F.contains(source, F.lit(w))
            holds = holds & some
        for w in without:
            holds = holds & ~F.contains(source, F.lit(w))
        out = hit if out is None else F.when(holds, hit).otherwise(out)
    return out


def _by_name(name: Column, versions: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
    version = F.try_element_at(table, name)
    return F.when(version.isNotNull(), _found(version, F.lit(NAMED), name))


def from_flags(text: Column) -> Column:
    """What the first ``-std=`` flag names, or null."""
    return _by_name(F.regexp_extract(text, r"^(?s:.*?)-std=([\p{L}\p{N}+]*)", 1), STANDARDS)


def from_build_file(text: Column) -> Column:
    """The Java version of a Maven or Gradle file, or null."""
    maven = F.regexp_extract(text, r"<maven\.compiler\.source>([^<]*)</", 1)
    gradle = F.regexp_extract(text, r"sourceCompatibility[^=]*=[\s'\"]*([0-9.]*)", 1)
    return _by_name(F.when(F.contains(text, F.lit("<maven.compiler.source>")), maven).otherwise(gradle), BUILDS)


# Versions by a file's ending.
ENDINGS = ((("c", "h"), "C11", 0.3), (("cpp", "cxx", "cc", "C", "c++"), "Cpp17", 0.4), (("hpp", "hxx", "h++"), "Cpp17", 0.4))


def from_extension(path: Column) -> Column:
    """A default by the file's ending, or null."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("struct<confidence:double,version:string,reason:string>")
    for endings, version, confidence in ENDINGS:
        out = F.when(ending.isin(*endings), _found(F.lit(version), F.lit(confidence), ending)).otherwise(out)
    return out


def strongest(*found: Column) -> Column:
    """The detection of most confidence; of equal ones the later; nulls are none."""
    placed = [F.when(x.isNotNull(), F.struct(x["confidence"].alias("confidence"), F.lit(i).alias("place"), x["version"].alias("version"), x["reason"].alias("reason"))) for i, x in enumerate(found)]
    best = F.array_max(F.array_compact(F.array(*placed)))
    return F.when(best.isNotNull(), _found(best["version"], best["confidence"], best["reason"]))


def of_cpp(path: Column, source: Column) -> Column:
    return strongest(from_flags(source), detect(source, CPP_RULES), from_extension(path))


def of_java(source: Column) -> Column:
    return strongest(from_build_file(source), detect(source, JAVA_RULES))
