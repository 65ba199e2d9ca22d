"""Defaults of the analysis. Values that results depend on stand together here."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, which results depend on.
ENTRY_POINTS = ("MainActivity", "Application", "main", "Main", "App")
GENERIC_NAMES = ("parse", "main", "run", "load", "init", "ensure", "check", "handle", "render")
TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "protocol", "record", "object", "mixin", "union", "actor", "type", "type_alias", "typedef")
OUTPUT_DIRS = ("build", "out", "dist", "target")
BUILD_MANIFESTS = (
    "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
    "pom.xml", "build.xml", "ivy.xml", "Cargo.toml", "package.json", "build.sbt",
    "setup.py", "pyproject.toml", "setup.cfg", "Makefile", "makefile",
    "CMakeLists.txt", "meson.build", "BUILD", "BUILD.bazel",
)
#: The folder in which a project keeps the settings and results of its analysis: our own name, skipped like the others.
STATE_DIR = ".archloom"
SKIP_DIRS = (
    ".git", ".hg", ".svn",
    "node_modules", "vendor",
    "third_party", "third-party", "Pods", "Carthage", "bower_components", ".cxx",
    "build", "dist", "out", "target", ".gradle",
    ".idea", ".vscode",
    "__pycache__", ".venv", "venv", ".env", ".pytest_cache", ".mypy_cache",
    "test", "tests", "testsuites", "androidTest", "__tests__",
    "commonTest", "jvmTest", "jsTest", "nativeTest", "jvmAndroidTest", "desktopTest",
    "androidHostTest", "androidUnitTest", "androidInstrumentedTest", "androidDeviceTest",
    "appleTest", "iosTest", "macosTest", "tvosTest", "watchosTest",
    "linuxTest", "mingwTest", "wasmJsTest", "wasmWasiTest",
    "mock", "mocks", "sample", "samples", "demo", "demos", "example", "examples",
    "fixtures", "testdata", "testFixtures",
    "assets",
    STATE_DIR,
)
#: Languages that are known but not read, by extension.
OTHER_LANGUAGES = {
    "sh": "shell", "bash": "shell", "zsh": "shell", "ksh": "shell",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby",
    "php": "php",
    "pl": "perl", "pm": "perl",
    "scala": "scala", "sc": "scala",
    "ex": "elixir", "exs": "elixir",
    "hs": "haskell",
    "jl": "julia",
}
#: Manifests that name a project's own packages, in its root and the folders below.
ROOT_MANIFESTS = ("build.gradle", "build.gradle.kts", "pom.xml")
#: Layers of a project that names none.
DEFAULT_LAYERS = [
    {"id": "presentation", "name": "Presentation", "order": 0,
     "summary_zh": "UI、导航、视图模型、控制器", "summary_en": "UI, navigation, view models, controllers",
     "path_segments": ["presentation", "ui", "view", "screen", "compose", "components", "pages", "handlers", "controllers", "routes", "endpoints"],
     "name_suffixes": ["Activity", "Fragment", "ViewModel", "Screen", "Controller", "View", "Page", "Handler", "Route"]},
    {"id": "domain", "name": "Domain", "order": 1,
     "summary_zh": "业务规则、用例、实体", "summary_en": "Business rules, use cases, entities",
     "path_segments": ["domain", "usecase", "use_case", "model", "entity", "service", "logic", "core"],
     "name_suffixes": ["UseCase", "Service", "Model", "Entity", "Aggregate", "DomainEvent", "Policy"]},
    {"id": "data", "name": "Data", "order": 2,
     "summary_zh": "仓储、数据源、持久化、API", "summary_en": "Repositories, data sources, persistence, APIs",
     "path_segments": ["data", "repository", "repo", "dao", "datasource", "db", "store", "persistence", "api", "client", "gateway", "remote", "local"],
     "name_suffixes": ["Repository", "Dao", "DataSource", "Store", "Client", "Gateway", "Api"]},
    {"id": "infrastructure", "name": "Infrastructure", "order": 3,
     "summary_zh": "DI、网络、工具、构建/运行时支撑", "summary_en": "DI, network, utilities, build/runtime plumbing",
     "path_segments": ["di", "ioc", "inject", "network", "net", "util", "utils", "common", "shared", "internal", "pkg", "cmd", "lib", "bin", "config", "infra"],
     "name_suffixes": ["Factory", "Module", "Provider", "Container", "Helper", "Util", "Config", "Bootstrap"]},
]
#: The layer of what no rule places.
REST_LAYER = {"id": "uncategorized", "name": "Uncategorized", "order": 99, "summary_zh": "无法自动归类", "summary_en": "Could not be assigned automatically", "path_segments": [], "name_suffixes": []}
EXCLUDED_TAG = "^(excluded|test|mock|sample|demo|example|fixture)"
UNCATEGORIZED = "uncategorized"


@dataclass(frozen=True)
class EngineConfig:
    core_percentile: float = 0.3
    core_min: int = 4
    core_max: int = 40
    hub_percentile: float = 0.05
    max_depth: int = 8
    max_seeds: int = 12
    max_nodes: int = 60
    max_fanout: int = 8
    max_dispatch_flows: int = 10
    max_collaborators: int = 3
    max_change_ratio: float = 0.4
    min_jaccard: float = 0.6
    fanout_threshold: int = 3
    in_weight: float = 0.7
    out_weight: float = 0.2
    entry_weight: float = 0.0
    private_factor: float = 0.3


DEFAULT = EngineConfig()
