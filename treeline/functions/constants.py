"""Fixed values.

These lists must equal the reference tool's rules for results to match; they
are stated plainly here, in the order the rules use them.
"""

# --- fixed values: ignore rule (scan) ---------------------------------------
# directory names matched as a lower-cased substring of a path segment
IGNORE_DIR_NAMES = [
    ".git", ".svn", ".hg",
    "__pycache__", ".pytest_cache",
    "venv", "env", ".venv", "ENV",
    "node_modules", "site-packages",
    "build", "dist", ".eggs",
    ".tox", ".coverage",
]
# directory globs (case-sensitive, anchored)
IGNORE_DIR_GLOBS = ["*.egg-info"]
# artifact directories: exact, case-sensitive segment match
ARTIFACT_DIRS = [
    ".next", "out", "_next", "dist", "build", "coverage",
    ".nuxt", ".output", ".vercel", ".netlify", "public/build", "static/chunks",
]
# file patterns (case-sensitive, anchored; '*' is the only wildcard)
IGNORE_FILE_PATTERNS = [
    "*.pyc", "*.pyo", "*.pyd",
    "*.so", "*.dll", "*.dylib",
    ".DS_Store", "Thumbs.db",
    "*.swp", "*.swo", "*~",
]

# --- fixed values: classifier ----------------------------------------------
CATEGORIES = ["src", "tests", "configs", "scripts", "docs", "markdown", "data",
              "experiments", "trash", "unknown"]
CONFIG_NAMES = [
    "setup.py", "setup.cfg", "pyproject.toml",
    "requirements.txt", "requirements-dev.txt",
    "Pipfile", "poetry.lock",
    ".gitignore", ".dockerignore",
    "Dockerfile", "docker-compose.yml",
    ".env", ".env.example",
    "tox.ini", "pytest.ini",
    ".flake8", ".pylintrc", "mypy.ini",
]
CONFIG_EXTENSIONS = [".ini", ".cfg", ".conf", ".yaml", ".yml", ".toml", ".json"]
DATA_EXTENSIONS = [".csv", ".tsv", ".json", ".xml", ".db", ".sqlite", ".sqlite3",
                   ".pkl", ".pickle", ".npy", ".npz", ".parquet", ".feather"]
DOC_EXTENSIONS = [".rst", ".txt", ".pdf", ".html", ".htm"]
SCRIPT_PREFIXES = ["run_", "main_", "cli_", "script_", "setup_", "deploy_", "build_"]
EXPERIMENT_PREFIXES = ["temp_", "tmp_", "demo_", "example_", "prototype_"]
EXPERIMENT_STEMS = ["experiment", "playground", "scratch", "test_run"]
EXPERIMENT_NAME_WORDS = ["experiment", "playground", "scratch"]
EXPERIMENT_PATH_WORDS = ["experiment", "playground", "scratch", "temp", "tmp"]
APP_IMPORTS = ["fastapi", "flask", "django", "sqlalchemy", "pydantic",
               "numpy", "pandas", "scikit-learn", "torch", "tensorflow"]
TEST_IMPORTS = ["pytest", "unittest", "mock", "testify", "hypothesis", "nose", "doctest"]
EXECUTABLE_NAME_PREFIXES = ["run_", "main_", "cli_"]

# --- fixed values: repository type -----------------------------------------
PYTHON_ROOT_FILES = ["setup.py", "setup.cfg", "pyproject.toml", "requirements.txt",
                     "Pipfile", "poetry.lock", "tox.ini", "pytest.ini"]
FRONTEND_ROOT_FILES = ["package.json", "package-lock.json", "yarn.lock", "angular.json",
                       "tsconfig.json", "webpack.config.js", "vite.config.js", "next.config.js"]
JAVA_ROOT_FILES = ["pom.xml", "build.gradle", "gradlew"]
DOTNET_EXTENSIONS = [".csproj", ".sln", ".fsproj", ".vbproj"]
RUBY_ROOT_FILES = ["Gemfile", "Rakefile"]
GO_ROOT_FILES = ["go.mod", "go.sum"]
TS_JS_EXTENSIONS = [".ts", ".js", ".tsx", ".jsx"]

# --- fixed values: ecosystem profiles (name, duplicate patterns) -----------
PROFILES = [
    ("python", []),
    ("nextjs", ["index.html", "index.tsx", "index.ts", "page.tsx", "layout.tsx",
                "_app.tsx", "_document.tsx"]),
    ("frontend-static", ["index.html", "index.js", "index.css"]),
]

# --- fixed values: proposals ------------------------------------------------
DUPLICATE_EXEMPT = ["__init__.py", "__main__.py", "conftest.py"]
ROOT_FLAG_EXEMPT = ["setup.py", "manage.py"]
ROOT_CONFIG_TARGETS = ["setup.py", "setup.cfg", "pyproject.toml", "requirements.txt", ".gitignore"]
STANDARD_ROOT_CONFIGS = ["setup.py", "setup.cfg", "pyproject.toml", "requirements.txt"]
COMMON_SCRIPT_NAMES = ["setup.py", "manage.py", "run.py"]
# config reason: first substring of the file name that matches, in this order
CONFIG_KINDS = [
    (".env", "environment variables"),
    (".yaml", "YAML configuration"),
    (".yml", "YAML configuration"),
    (".toml", "TOML configuration"),
    (".ini", "INI configuration"),
    (".json", "JSON configuration"),
    ("requirements.txt", "Python dependencies"),
    ("Pipfile", "Python dependencies"),
    ("pyproject.toml", "Python project metadata"),
]
# data reason: exact extension
DATA_KINDS = [
    (".json", "JSON data"),
    (".csv", "CSV data"),
    (".txt", "text data"),
    (".xml", "XML data"),
    (".yaml", "YAML data"),
]
DUPLICATE_HIGH_RISK = ["requirements.txt", ".env", "dockerfile", "docker-compose.yml",
                       "docker-compose.yaml", "package.json", "package-lock.json", "yarn.lock",
                       "pipfile", "pipfile.lock", "setup.py", "pyproject.toml"]
DUPLICATE_LOW_RISK = ["readme.md", "changelog.md", "license", "license.md", "license.txt",
                      "contributing.md"]
DUPLICATE_LOW_SUFFIXES = [".log", ".tmp"]

# --- fixed values: display groups of a proposal ------------------------------
GROUP_ORDER = ["Configuration", "Dependencies", "Documentation", "Source Code", "Tests",
               "Scripts", "Logs & Artifacts", "Other"]
GROUP_CONFIG_NAMES = [".env", ".gitignore", ".editorconfig", ".dockerignore", "setup.py",
                      "setup.cfg", "pyproject.toml", "tox.ini", "pytest.ini", ".flake8",
                      ".pylintrc", "tsconfig.json", "angular.json", "webpack.config.js",
                      ".eslintrc", ".prettierrc"]
GROUP_CONFIG_EXTENSIONS = [".ini", ".cfg", ".conf", ".yaml", ".yml", ".toml"]
GROUP_DEPENDENCY_NAMES = ["requirements.txt", "requirements-dev.txt", "Pipfile", "poetry.lock",
                          "package.json", "package-lock.json", "yarn.lock", "Gemfile", "go.mod",
                          "go.sum", "pom.xml"]
GROUP_LOG_SUFFIXES = [".log", ".tmp", ".cache"]
GROUP_DOC_SUFFIXES = [".md", ".rst", ".txt", "LICENSE", "CHANGELOG"]
GROUP_CODE_SUFFIXES = [".py", ".ts", ".js"]

# --- fixed values: message texts ------------------------------------------------
TRASH_REASON = "Could not classify - needs manual review"
ROOT_FLAG_REASON = "Python file at repository root"
ROOT_FLAG_SUGGESTION = "Consider moving to src/ or scripts/"
DUPLICATE_PREFIX = "Duplicate filename:"
INTERPRETATIONS = [
    ("HIGH", "Interpretation: Changes appear safe to apply."),
    ("MEDIUM", "Interpretation: Review changes carefully before applying."),
    ("LOW", "Interpretation: High risk - consider smaller batches or manual review."),
]

# --- fixed values: message templates ({name} marks a value) -----------------
# move reasons, by category, in the order the sentences are tested
REASON_TEST_FUNCTIONS = "Contains test functions or test classes (pytest/unittest pattern detected)"
REASON_TEST_IMPORTS = "Imports testing frameworks: {frameworks}"
REASON_TEST_NAMING = "Follows test file naming convention"
REASON_TEST_LOCATION = "Currently located in {location}, should be in tests/ directory"
REASON_SRC_IMPORTS = "Contains {n} imports, indicating application logic"
REASON_SRC_MANY = "Multiple dependencies suggest core application module"
REASON_SRC_LIBRARY = "Non-executable library code (not a script)"
REASON_SRC_ROOT = "Python modules should be organized under src/ or package directory"
REASON_SCRIPT_MAIN = "Contains __main__ block, indicating executable entry point"
REASON_SCRIPT_NAME = "Common script name pattern detected"
REASON_SCRIPT_ROOT = "Executable scripts should be organized in scripts/ directory"
REASON_CONFIG_KIND = "Configuration file: {kind}"
REASON_CONFIG_DEFAULT = "Configuration file detected by naming pattern"
REASON_CONFIG_ROOT = "Standard root-level configuration file"
REASON_CONFIG_MOVE = "Should be organized in configs/ directory"
REASON_EXPERIMENT_NAME = "Temporary or experimental file naming pattern"
REASON_EXPERIMENT_PLAYGROUND = "Located in experimental/playground area"
REASON_EXPERIMENT_ADVICE = "Consider moving to experiments/ or removing if obsolete"
REASON_README = "Primary project README - should remain at repository root"
REASON_MARKDOWN = "Markdown documentation file"
REASON_MARKDOWN_ROOT = "Documentation files should be organized in docs/ directory"
REASON_DATA_KIND = "Data file: {kind}"
REASON_DATA_DEFAULT = "Data file detected"
REASON_DATA_ROOT = "Data files should be organized in data/ directory"
REASON_FALLBACK = "Classified as {category} based on file analysis"
ROOT_LOCATION = "repository root"
ROOT_DETAIL_LOCATION = "root"
# duplicate groups
DUPLICATE_REASON = "Duplicate filename: {n} files named '{name}'"
DUPLICATE_REMAINING = "+{n} more"
# import warnings
IMPORT_RELATIVE = "Relative import will break when moving from {source_dir}/ to {target_dir}/"
IMPORT_SIBLING_STAYS = "Importing '{module}' from current directory, but moving away from {source_dir}/"
IMPORT_SIBLING_MOVES = "Importing '{module}' from same directory, but {file} is moving to {other_dir}/"
# version control
GIT_UNCOMMITTED = "Uncommitted changes detected"
GIT_TRACKED = "{n} files to move are Git-tracked"
# confidence factors
FACTOR_PYTHON = "Python-dominant repository"
FACTOR_OTHER_TYPE = "{repo_type} repository"
FACTOR_NON_PYTHON = "Non-Python repository (higher risk)"
FACTOR_TESTS = "Tests detected (easier to validate changes)"
FACTOR_NO_TESTS = "No tests detected (harder to validate)"
FACTOR_NO_MOVES = "No structural changes proposed"
FACTOR_FEW_MOVES = "Small number of changes ({n} moves)"
FACTOR_SOME_MOVES = "Moderate number of changes ({n} moves)"
FACTOR_MANY_MOVES = "Large number of changes ({n} moves)"
FACTOR_HIGH = "{n} high-risk moves"
FACTOR_MEDIUM = "{n} medium-risk moves"
FACTOR_ALL_LOW = "All moves are low-risk ({n} moves)"
FACTOR_WARNINGS = "{n} potential import breakage(s)"
FACTOR_NO_WARNINGS = "No import breakage warnings"
FACTOR_DRY_RUN = "Dry-run mode (simulation only)"
# execution and rollback
MSG_NO_SOURCE = "Source path is None"
MSG_NO_TARGET = "Target path is None"
MSG_SOURCE_MISSING = "Source file does not exist: {path}"
MSG_SOURCE_NOT_FILE = "Source is not a file: {path}"
MSG_TARGET_EXISTS = "Target already exists (conflict): {path}"
MSG_PARENT_NOT_DIR = "Target parent exists but is not a directory: {path}"
MSG_VALIDATION_FAILED = "Validation failed: {error}"
MSG_DRY_RUN_MOVE = "[DRY-RUN] Would move {source} -> {target}"
MSG_MOVED = "Moved {source} -> {target}"
MSG_UNSUPPORTED = "Unsupported action: {action} (only MOVE supported in V2.1)"
MSG_ROLLBACK_TARGET_MISSING = "Rollback validation failed: Target file does not exist: {path}"
MSG_ROLLBACK_SOURCE_EXISTS = "Rollback validation failed: Source location already exists (conflict): {path}"
MSG_DRY_RUN_ROLLBACK = "[DRY-RUN] Would rollback {source} -> {target}"
MSG_ROLLED_BACK = "Rolled back {source} -> {target}"
MSG_EXEC_FAILED = "Failed to execute: {error}"
MSG_ROLLBACK_FAILED = "Rollback failed: {error}"
# (the reference puts the operating system's error text in {error}; ours is this fixed text)
MSG_NOT_A_DIRECTORY = "Not a directory: {path}"
ROLLBACK_REASON = "Rollback of {source} -> {target}"
# printed forms
IMPORT_FROM = "from {dots}{module} import {names}"
IMPORT_PLAIN = "import {module}"
WARNING_HEAD = "[!] Import Risk in {source}:"
WARNING_LINE = "    Line {line}: {statement}"
WARNING_RISK = "    Risk: {reason}"
WARNING_AFFECTED = "    Affected: {files}"
PROPOSAL_HEAD = "{ACTION}: {source}"
PROPOSAL_TARGET = "    -> {target}"
PROPOSAL_REASON = "REASON: {reason}"
PROPOSAL_RISK = "RISK: {RISK}"
PROPOSAL_EXAMPLES = "  Examples:"
PROPOSAL_EXAMPLE = "    - {path}"
PROPOSAL_REMAINING = "    ({remaining})"
PROPOSAL_DETAIL = "  {key}: {value}"
TREE_TEE, TREE_ELBOW, TREE_PIPE, TREE_SPACE = "├── ", "└── ", "│   ", "    "
TREE_NOTE = "... showing {shown} of {total} affected files"
NEW_DIRS_MORE = " (+{n} more)"
