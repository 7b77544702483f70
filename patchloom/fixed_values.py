"""Fixed values.

Everything in this module is data that decides results: lookup tables, word
lists, thresholds, texts and the element patterns.  The values are fixed; they
are written out plainly so they can be read and compared.  No logic lives here.
"""

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".php": "php",
    ".rb": "ruby",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".json": "json",
    ".xml": "xml",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".md": "markdown",
    ".sh": "bash",
    ".sql": "sql",
    ".r": "r",
    ".m": "matlab",
    ".pl": "perl",
}

# Whole lower-cased path -> language, tested before the extension.
LANGUAGE_BY_NAME = {
    "makefile": "makefile",
    "dockerfile": "dockerfile",
    "package.json": "json",
    "tsconfig.json": "json",
    ".gitignore": "config",
    ".env": "config",
}
README_PREFIX = "readme"
README_LANGUAGE = "markdown"
UNKNOWN = "unknown"

# Language -> element type -> pattern, anchored at the line start.
# Written for one line of code; functions/regex.py puts them into the dialect
# Spark runs.
ELEMENT_PATTERNS = {
    "python": {
        "function": r"^\s*def\s+(\w+)\s*\(([^)]*)\):",
        "class": r"^\s*class\s+(\w+)(?:\([^)]*\))?:",
        "import": r"^\s*(?:from\s+[\w.]+\s+)?import\s+([\w.,\s*]+)",
        "variable": r"^\s*(\w+)\s*=",
        "decorator": r"^\s*@(\w+)",
    },
    "javascript": {
        "function": r"^\s*(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:function|\([^)]*\)\s*=>))",
        "class": r"^\s*class\s+(\w+)",
        "import": r"^\s*import\s+(?:{[^}]+}|\w+)\s+from\s+['\"][^'\"]+['\"]",
        "variable": r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?!function|\([^)]*\)\s*=>)[^;]+;?",
        "method": r"^\s*(\w+)\s*\([^)]*\)\s*{",
    },
    "typescript": {
        "function": r"^\s*(?:function\s+(\w+)|(?:const|let)\s+(\w+)\s*:\s*\([^)]*\)\s*=>)",
        "class": r"^\s*(?:export\s+)?class\s+(\w+)",
        "interface": r"^\s*(?:export\s+)?interface\s+(\w+)",
        "import": r"^\s*import\s+(?:{[^}]+}|\w+)\s+from\s+['\"][^'\"]+['\"]",
        "type": r"^\s*(?:export\s+)?type\s+(\w+)",
    },
    "java": {
        "class": r"^\s*(?:public\s+)?class\s+(\w+)",
        "method": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[\w<>]+\s+(\w+)\s*\(",
        "import": r"^\s*import\s+([\w.]+);",
        "variable": r"^\s*(?:private|public|protected)?\s*(?:static\s+)?[\w<>]+\s+(\w+)\s*[=;]",
    },
    "go": {
        "function": r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(",
        "struct": r"^\s*type\s+(\w+)\s+struct",
        "interface": r"^\s*type\s+(\w+)\s+interface",
        "import": r"^\s*import\s+(?:\"[^\"]+\"|`[^`]+`)",
        "variable": r"^\s*(?:var\s+)?(\w+)\s*:?=",
    },
    "rust": {
        "function": r"^\s*(?:pub\s+)?fn\s+(\w+)\s*\(",
        "struct": r"^\s*(?:pub\s+)?struct\s+(\w+)",
        "enum": r"^\s*(?:pub\s+)?enum\s+(\w+)",
        "trait": r"^\s*(?:pub\s+)?trait\s+(\w+)",
        "impl": r"^\s*impl(?:\s*<[^>]*>)?\s+(?:(\w+)|(\w+)\s+for\s+(\w+))",
        "use": r"^\s*use\s+([\w::{},\s*]+);",
    },
}
ANONYMOUS = "anonymous"

# Purposes by kind of file change.
PURPOSE_BY_KIND = {
    "added": "New file creation",
    "deleted": "File removal",
    "renamed": "File reorganization",
}

# Purposes by structural change.
PURPOSE_FUNCTION_ADDED = "Feature addition"
PURPOSE_FUNCTION_REMOVED = "Code cleanup or deprecation"
PURPOSE_FUNCTION_MODIFIED = "Bug fix or enhancement"
PURPOSE_CLASS_ADDED = "New component or module"
PURPOSE_CLASS_REMOVED = "Architecture refactoring"
PURPOSE_CLASS_MODIFIED = "Class enhancement"
PURPOSE_IMPORT_ADDED = "Dependency addition"
PURPOSE_IMPORT_REMOVED = "Dependency cleanup"

# Purposes by words in the lower-cased added text.
PURPOSE_BY_ADDED_WORDS = {
    "Test coverage improvement": ["test", "spec", "assert", "expect"],
    "Debugging or logging enhancement": ["log", "debug", "print", "console"],
    "Error handling improvement": ["error", "exception", "try", "catch"],
    "Technical debt or temporary fix": ["todo", "fixme", "hack"],
}
# The same for the removed text, the readme rule and comment marks.
PURPOSE_BY_REMOVED_WORDS = {
    "Technical debt resolution": ["todo", "fixme", "hack"],
}
PURPOSE_README = "Documentation update"
PURPOSE_BY_COMMENT_MARKS = {
    "Documentation improvement": ['"""', "'''", "//", "/*", "#"],
}
PURPOSE_DEFAULT = "Code modification"
PURPOSE_FAILED = "Analysis failed"

# Every purpose the engine itself can give a file, in the order
# in which they stand in one file's list.
KNOWN_PURPOSES = [
    "New file creation",
    "File removal",
    "File reorganization",
    "Feature addition",
    "Code cleanup or deprecation",
    "Bug fix or enhancement",
    "New component or module",
    "Architecture refactoring",
    "Class enhancement",
    "Dependency addition",
    "Dependency cleanup",
    "Test coverage improvement",
    "Debugging or logging enhancement",
    "Error handling improvement",
    "Technical debt or temporary fix",
    "Technical debt resolution",
    "Documentation update",
    "Documentation improvement",
    "Code modification",
    "Analysis failed",
]

# Impact texts.
IMPACT_BY_KIND = {
    "added": "New functionality introduced",
    "deleted": "Functionality removed - may break dependencies",
    "renamed": "Import paths may need updating",
}
IMPACT_LARGE = "Large-scale changes - high impact"
IMPACT_MEDIUM = "Medium-scale changes - moderate impact"
IMPACT_SMALL = "Small-scale changes - low impact"
IMPACT_LARGE_OVER = 100
IMPACT_MEDIUM_OVER = 20
IMPACT_PUBLIC = "Public API changes (%d elements) - may affect external code"
IMPACT_PRIVATE = "Internal implementation changes (%d elements)"
IMPACT_CLASS = "Class structure changes - may affect inheritance"
IMPACT_IMPORT = "Dependency changes - may affect build process"
IMPACT_BY_SUFFIX = [
    ((".py", ".js", ".ts", ".java"), "Core application code - runtime impact"),
    ((".json", ".yaml", ".yml", ".xml"), "Configuration changes - may affect deployment"),
    ((".md", ".txt", ".rst"), "Documentation changes - no runtime impact"),
]
IMPACT_FAILED = "Unable to assess impact"

# Complexity score.
SCORE_BY_LINES_OVER = [(200, 4), (100, 3), (50, 2), (10, 1)]
SCORE_MAX_ELEMENTS = 3
SCORE_HEAVY_TYPES = ["class_added", "class_modified", "interface_added", "interface_modified"]
SCORE_HEAVY = 2
SCORE_MAX_MODIFIED = 2
SCORE_HARDER_LANGUAGES = ["cpp", "rust", "java"]
SCORE_EASIER_LANGUAGES = ["json", "yaml", "markdown"]
SCORE_BY_KIND = {"renamed": 1, "deleted": 2}
SCORE_CAP = 10
SCORE_HIGH = 7
SCORE_MEDIUM = 4

# Limits of the change-set report.
TOP_PURPOSES = 3
MAX_KEY_CHANGES = 10
MAX_RECOMMENDATIONS = 8
NEW_FILES_LISTED = 3
LARGE_FILE_OVER = 100
CLASS_CHANGES_OVER = 2
LARGE_CHANGE_SET_OVER = 500

# Texts of the change-set report.
NO_CHANGES = "No changes detected"
ROLLUP_FAILED = "Error generating summary"
FILE_SUMMARY_FAILED = "Error generating summary for "
ROLLUP_FAILED_ADVICE = "Review failed - manual analysis recommended"
NOTE_HIGH = "High complexity change in "
NOTE_NEW = "New file: "
NOTE_MANY_NEW = "Multiple new files added (%d files)"
NOTE_DELETED = "Deleted file: "
NOTE_LARGE = "Large change in %s (%d lines)"
NOTE_CLASSES = "Multiple class changes in "
ADVICE_HIGH = "Review %d high-complexity changes carefully"
ADVICE_TESTS = "Consider adding tests for the new functionality"
ADVICE_DOCS = "Consider updating documentation for new features"
ADVICE_API = "API changes detected - ensure backward compatibility"
ADVICE_SIZE = "Large-scale changes - consider breaking into smaller commits"
ADVICE_IMPORTS = "Dependency changes detected - verify build and deployment"
FILE_HIGH_SCORE = "High complexity change (score: %d/10)"
FILE_MEDIUM_SCORE = "Medium complexity change (score: %d/10)"
FILE_HIGH_IMPACT = "High impact change - review carefully"

# Names of output formats and template variables.
FORMATS = ["json", "markdown", "md", "plain", "text"]
TEMPLATE_VARIABLES = [
    "overview",
    "total_files",
    "files_added",
    "files_modified",
    "files_deleted",
    "lines_added",
    "lines_removed",
    "key_changes",
    "recommendations",
    "file_summaries",
]
NO_FILE_SUMMARIES = "No file changes"

# Labels of the six counters in plain and Markdown reports.
COUNTER_LABELS = {
    "total_files": "Total files changed",
    "files_added": "Files added",
    "files_modified": "Files modified",
    "files_deleted": "Files deleted",
    "total_lines_added": "Lines added",
    "total_lines_removed": "Lines removed",
}
