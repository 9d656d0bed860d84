"""File types by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type by extension.
BY_EXTENSION = {
    ".go": "go", ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rb": "ruby", ".erb": "ruby", ".rake": "ruby", ".php": "php",
    ".cs": "csharp", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rs": "rust", ".swift": "swift", ".m": "objc",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".sql": "sql", ".tf": "terraform", ".tfvars": "terraform", ".hcl": "hcl",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".xml": "xml", ".html": "html", ".htm": "html", ".vue": "vue",
    ".svelte": "svelte", ".css": "css", ".scss": "css", ".md": "markdown", ".proto": "proto", ".gradle": "gradle", ".groovy": "groovy", ".dart": "dart",
    ".ex": "elixir", ".exs": "elixir", ".pl": "perl", ".lua": "lua", ".env": "dotenv",
}
#: File type by whole name.
BY_NAME = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "make", "jenkinsfile": "groovy", "gemfile": "ruby", "rakefile": "ruby", "vagrantfile": "ruby",
    "procfile": "config", "requirements.txt": "python-deps", "pipfile": "python-deps", "pyproject.toml": "python-deps", "poetry.lock": "lockfile", "package.json": "node-deps",
    "package-lock.json": "lockfile", "yarn.lock": "lockfile", "pnpm-lock.yaml": "lockfile", "go.mod": "go-deps", "go.sum": "lockfile", "cargo.toml": "rust-deps",
    "cargo.lock": "lockfile", "gemfile.lock": "lockfile", "composer.json": "php-deps", "composer.lock": "lockfile", "pom.xml": "java-deps", "build.gradle": "java-deps",
    "build.gradle.kts": "java-deps", "go.work": "go-deps", "terraform.tfstate": "terraform", ".env": "dotenv", ".npmrc": "config", ".gitlab-ci.yml": "ci", "codeowners": "config",
    "docker-compose.yml": "compose", "docker-compose.yaml": "compose",
}

KNOWN = sorted({*BY_EXTENSION.values(), *BY_NAME.values(), "unknown", "ci", "compose", "config", "lockfile"})


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column) -> Column:
    """The type of a file: by its whole name, by how the name starts, by extension; YAML of workflows is ci."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    kind = _lookup(F.regexp_extract(name, r"(\.[^.]*)$", 1), BY_EXTENSION)
    workflow = (kind == "yaml") & F.lower(path).contains(".github/workflows/")
    return (
        F.when(F.coalesce(_lookup(name, BY_NAME), F.lit("")) != "", _lookup(name, BY_NAME))
        .when(name.startswith("dockerfile"), "dockerfile")
        .when(name.startswith(".env"), "dotenv")
        .when(workflow, "ci")
        .otherwise(F.coalesce(kind, F.lit("unknown")))
    )
