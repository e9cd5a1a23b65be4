"""Fixed values that results depend on: word lists, rule tables, patterns."""

from __future__ import annotations

# Keyword, category, emoji, weight. A keyword is a substring, blanks at its ends included.
CATEGORY_KEYWORDS = (
    ("how to activate", "Documentation", "📚", 10),
    ("how to use", "Documentation", "📚", 10),
    ("how to", "Documentation", "📚", 8),
    ("guide", "Documentation", "📚", 7),
    ("tutorial", "Documentation", "📚", 7),
    ("documentation", "Documentation", "📚", 7),
    ("instructions", "Documentation", "📚", 7),
    ("readme", "Documentation", "📚", 6),
    ("manual", "Documentation", "📚", 6),
    ("steps to", "Documentation", "📚", 6),
    ("you can", "Documentation", "📚", 4),
    ("to enable", "Documentation", "📚", 5),
    ("to activate", "Documentation", "📚", 5),
    ("function(", "Code Snippets", "💻", 8),
    ("class ", "Code Snippets", "💻", 7),
    ("import {", "Code Snippets", "💻", 8),
    ("const ", "Code Snippets", "💻", 6),
    ("let ", "Code Snippets", "💻", 6),
    ("var ", "Code Snippets", "💻", 6),
    ("def ", "Code Snippets", "💻", 7),
    ("async function", "Code Snippets", "💻", 8),
    ("=> {", "Code Snippets", "💻", 7),
    ("struct {", "Code Snippets", "💻", 7),
    ("interface {", "Code Snippets", "💻", 7),
    ("public class", "Code Snippets", "💻", 8),
    ("private ", "Code Snippets", "💻", 5),
    ("docker-compose ", "Docker Commands", "🐳", 8),
    ("docker compose ", "Docker Commands", "🐳", 8),
    ("docker run", "Docker Commands", "🐳", 7),
    ("docker build", "Docker Commands", "🐳", 7),
    ("docker ", "Docker Commands", "🐳", 5),
    ("npm install", "Node Commands", "📦", 7),
    ("npm run", "Node Commands", "📦", 7),
    ("yarn ", "Node Commands", "📦", 7),
    ("pnpm ", "Node Commands", "📦", 7),
    ("npx ", "Node Commands", "📦", 7),
    ("npm ", "Node Commands", "📦", 5),
    ("git commit", "Git Commands", "🔀", 7),
    ("git push", "Git Commands", "🔀", 7),
    ("git pull", "Git Commands", "🔀", 7),
    ("git ", "Git Commands", "🔀", 5),
    ("cargo build", "Rust Commands", "🦀", 7),
    ("cargo run", "Rust Commands", "🦀", 7),
    ("cargo test", "Rust Commands", "🦀", 7),
    ("cargo ", "Rust Commands", "🦀", 5),
    ("rustc ", "Rust Commands", "🦀", 5),
    ("python ", "Python Commands", "🐍", 6),
    ("pip install", "Python Commands", "🐍", 7),
    ("pip ", "Python Commands", "🐍", 5),
    ("poetry ", "Python Commands", "🐍", 6),
    ("kubectl ", "Kubernetes Commands", "☸️", 7),
    ("helm ", "Kubernetes Commands", "☸️", 7),
    ("k9s ", "Kubernetes Commands", "☸️", 7),
    ("deploy workflow", "Deployment", "🚀", 9),
    ("deploy to", "Deployment", "🚀", 8),
    ("deploy", "Deployment", "🚀", 7),
    ("deployment", "Deployment", "🚀", 7),
    ("workflow", "Workflows", "⚙️", 7),
    ("ci/cd", "CI/CD", "🔄", 8),
    ("ci cd", "CI/CD", "🔄", 8),
    ("continuous integration", "CI/CD", "🔄", 8),
    ("continuous deployment", "CI/CD", "🔄", 8),
    ("pipeline", "Pipelines", "🔧", 7),
    ("coolify", "Coolify", "🚀", 8),
    ("github actions", "CI/CD", "🔄", 8),
    ("gitlab ci", "CI/CD", "🔄", 8),
    ("jenkins", "CI/CD", "🔄", 7),
    ("circleci", "CI/CD", "🔄", 7),
    ("travis ci", "CI/CD", "🔄", 7),
    ("infrastructure", "Infrastructure", "🏗️", 7),
    ("devops", "DevOps", "🔧", 7),
    ("automation", "Automation", "🤖", 6),
    ("orchestration", "Orchestration", "🎼", 6),
    ("terraform", "Infrastructure", "🏗️", 7),
    ("ansible", "Automation", "🤖", 7),
    ("kubernetes", "Kubernetes", "☸️", 6),
    ("aws ", "Cloud Commands", "☁️", 6),
    ("gcloud ", "Cloud Commands", "☁️", 6),
    ("az ", "Cloud Commands", "☁️", 6),
    ("ssh ", "System Commands", "🔧", 6),
    ("scp ", "System Commands", "🔧", 6),
    ("rsync ", "System Commands", "🔧", 6),
    ("sudo ", "System Commands", "🔧", 5),
    ("make ", "Build Commands", "🔨", 6),
    ("cmake ", "Build Commands", "🔨", 6),
    ("gradle ", "Build Commands", "🔨", 6),
    ("mvn ", "Build Commands", "🔨", 6),
    ("brew ", "Package Management", "📦", 4),
    ("apt ", "Package Management", "📦", 4),
    ("$ ", "Shell Commands", "⌨️", 3),
    ("<html", "Web Development", "🌐", 8),
    ("</div>", "Web Development", "🌐", 7),
    ("css:", "Web Development", "🌐", 6),
    ("react component", "Web Development", "🌐", 8),
    ("api endpoint", "Web Development", "🌐", 7),
    ("fetch(", "Web Development", "🌐", 7),
    ("axios", "Web Development", "🌐", 6),
    ("select * from", "Database", "🗄️", 8),
    ("insert into", "Database", "🗄️", 8),
    ("update ", "Database", "🗄️", 4),
    ("delete from", "Database", "🗄️", 7),
    ("create table", "Database", "🗄️", 8),
    ("database", "Database", "🗄️", 5),
    ("query", "Database", "🗄️", 4),
    ("sql", "Database", "🗄️", 5),
    ("idea:", "Ideas", "💡", 7),
    ("thinking about", "Ideas", "💡", 6),
    ("note:", "Notes", "📝", 6),
    ("remember to", "Notes", "📝", 5),
    ("todo:", "Tasks", "✅", 7),
    ("task:", "Tasks", "✅", 7),
    ("[ ]", "Tasks", "✅", 6),
    ("http://", "Links", "🔗", 8),
    ("https://", "Links", "🔗", 8),
    ("www.", "Links", "🔗", 6),
    ("config:", "Configuration", "⚙️", 6),
    ("settings:", "Configuration", "⚙️", 6),
    (".env", "Configuration", "⚙️", 7),
    (".json", "Configuration", "⚙️", 4),
    (".yaml", "Configuration", "⚙️", 5),
    (".toml", "Configuration", "⚙️", 5),
    ("error:", "Errors & Fixes", "🐛", 7),
    ("exception:", "Errors & Fixes", "🐛", 7),
    ("bug:", "Errors & Fixes", "🐛", 6),
    ("fix:", "Errors & Fixes", "🐛", 6),
    ("failed to", "Errors & Fixes", "🐛", 5),
    ("traceback", "Errors & Fixes", "🐛", 7),
    ("research:", "Research", "🔬", 7),
    ("study:", "Learning", "📖", 6),
    ("learning about", "Learning", "📖", 6),
    ("article:", "Articles", "📰", 6),
    ("blog post", "Articles", "📰", 6),
)

# First words that mark a shell command in summaries.
SUMMARY_COMMANDS = ("ls", "cd", "git", "npm", "cargo", "docker", "kubectl", "cat", "grep", "find", "curl", "wget", "ssh", "scp", "rsync", "mkdir", "rm", "mv", "cp")

# Commands that are never saved, and those that always are.
COMMAND_BLOCKLIST = ("ls", "cd", "pwd", "clear", "exit", "history", "which", "type")
COMMAND_ALLOWLIST = (
    "docker", "git", "kubectl", "npm", "cargo", "python", "python3", "node", "ffmpeg", "curl", "wget", "aws", "gcloud", "az", "terraform", "ansible", "ssh", "scp", "rsync", "yarn", "pnpm",
    "bun", "go", "rust", "rustc", "javac", "java", "gcc", "make", "cmake", "mvn", "gradle", "pytest", "jest", "mocha", "rails", "rake", "bundle", "composer", "php", "perl", "ruby",
)
COMMAND_MIN_LENGTH = 30

# Tools of a command family, its category and emoji.
COMMAND_FAMILIES = (
    (("docker",), "Docker Commands", "🐳"),
    (("node", "npm", "npx", "yarn", "pnpm", "ts-node", "nodemon"), "Node Commands", "📦"),
    (("git",), "Git Commands", "🔀"),
    (("kubectl", "helm", "k9s"), "Kubernetes Commands", "☸️"),
    (("cargo", "rustc", "rustup"), "Rust Commands", "🦀"),
    (("python", "pip", "poetry"), "Python Commands", "🐍"),
    (("aws", "gcloud", "az"), "Cloud Commands", "☁️"),
    (("ssh", "scp", "rsync"), "System Commands", "🔧"),
    (("make", "cmake", "gradle", "mvn"), "Build Commands", "🔨"),
)

# Emoji of an app's folder; any other app has the last.
APP_EMOJI = (("Cursor", "⌨️"), ("Chrome", "🌐"), ("Safari", "🌐"), ("Firefox", "🌐"), ("VS Code", "💻"), ("VSCode", "💻"), ("Terminal", "🖥️"), ("Notes", "📝"))
OTHER_APP_EMOJI = "📱"

# Prefixes and keywords of a caption's content type, in order of precedence.
CAPTION_PREFIXES = (
    ("Code", ("code:",)),
    ("Terminal", ("terminal:", "shell:", "command:")),
    ("WebPage", ("web:", "webpage:", "browser:")),
    ("Document", ("document:", "pdf:", "text:")),
    ("Design", ("design:", "ui:", "mockup:")),
    ("Chat", ("chat:", "message:", "conversation:")),
)
CAPTION_KEYWORDS = (
    ("Code", ("code", "programming", "function", "variable", "class", "import")),
    ("Terminal", ("terminal", "command line", "shell", "prompt", "$", "#")),
    ("WebPage", ("webpage", "browser", "url", "website", "http")),
    ("Document", ("document", "pdf", "text document")),
    ("Design", ("design", "ui", "mockup", "wireframe", "prototype")),
    ("Chat", ("chat", "message", "conversation", "discord", "slack")),
)

# Marks of code lines.
CODE_KEYWORDS = ("function ", "const ", "let ", "var ", "def ", "class ", "import ", "export ")
CODE_SYMBOLS = (" => ", "() {", "};", "() =>")

# Entity patterns.
URL_PATTERN = r"(?i)\b(?:https?://|www\.)[a-z0-9][-a-z0-9+&@#/%?=~_|!:,.;]*[a-z0-9]"
EMAIL_PATTERN = r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PATH_PATTERN = r"(?:/[a-zA-Z0-9._-]+)+/?|[a-zA-Z]:\\(?:[a-zA-Z0-9._-]+\\)*[a-zA-Z0-9._-]*"
CODE_PATTERN = r"\b[a-z][a-zA-Z0-9]*(?:[A-Z][a-z0-9]*)+\b|\b[a-z_][a-z0-9_]*\([^)]*\)"
COMMAND_LINE_PATTERN = r"^[$>]\s+.+$"

# Lines that are user-interface noise.
NOISE_PATTERNS = (
    r"^[xX+\-©®™@&#*⋮⋯…]{1,3}$",
    r"^\s*[|()\[\]{}]\s*$",
    r"^[•●○◦▪▫■□◆◇★☆✓✗✕✖]+$",
    r"^\d{1,2}[:.,-]\d{2}\s*(?:am|pm|AM|PM)?$",
    r"^[\d/\-:,\s]+$",
    r"^[<>◀▶←→↑↓⇧⇩]+$",
    r"^[^\w\s]{3,}$",
    r"^\([0-9]+\)$",
    r"^\[[0-9]+\]$",
    r"^[WVwv✓✗]$",
    r"^(?:Minimize|Maximize|Close|Restore)$",
)
NOISE_WORDS = ("menu", "toolbar", "sidebar", "menubar", "minimize", "maximize", "close", "restore")

# Characters that recognition confuses, and their replacements.
CONFUSED_WORDS = (("l", "1"), ("O", "0"), ("rn", "m"), ("vv", "w"))
CONFUSED_FROM = "〈〉‹›‘’“”–—│─┌┐└┘├┤┬┴┼"
CONFUSED_TO = "<><>''\"\"--|-+++++++++"

# Emoji blocks, by first and last code point.
EMOJI_BLOCKS = ((0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0xFE00, 0xFE0F), (0x1F1E0, 0x1F1FF))

# Search and ranking constants.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RECENCY_SCORE, RECENCY_AGE, RECENCY_DAYS = 0.8, 0.2, 30
RRF_K = 60
SEARCH_LIMIT = 10
COSINE_FLOOR = 0.3
CENTROID_LEAST = 2
CLASSIFY_FLOOR, CLASSIFY_FLOOR_SCREENSHOT = 0.75, 0.65

# Category names by keywords in the first 200 characters, in order of precedence.
FALLBACK_LENGTH = 200
FALLBACK_BUSINESS = (
    ("case study", "Business Case Studies"), ("partnership", "Business Partnerships"), ("success story", "Business Success Stories"), ("testimonial", "Business Testimonials"), ("harnesses", "Business Content"),
    ("transformed", "Business Transformation"), ("company", "Business Content"), ("firm", "Business Content"), ("corporation", "Business Content"),
)
FALLBACK_INDUSTRY = ((("aec", "architecture", "engineering"), "AEC Business Content"), (("construction",), "Construction Business Content"), (("marketing",), "Marketing Content"))
FALLBACK_PRODUCT = ("joist", "ai")
FALLBACK_PROPOSAL = (("aec", "proposal"), "AEC Proposal Management", "AI Business Tools")
FALLBACK_TOPICS = ((("api", "documentation", "reference"), "Documentation"), (("code", "function", "class"), "Code Snippets"), (("news", "article", "breaking"), "News & Articles"))
FALLBACK_TYPES = (("command", "Commands"), ("screenshot", "Screenshots"), ("text", "Text Content"))
FALLBACK_LAST = "General Content"

# Titles of blank tabs and their sites.
BLANK_TAB_SITES = (("Gmail", "https://mail.google.com"), ("Google Docs", "https://docs.google.com"), ("Google Drive", "https://drive.google.com"), ("YouTube", "https://www.youtube.com"))
# Characters that cleaning keeps.
KEPT_CHARACTERS = r"\x20-\x7E\t\n\r -ɏḀ-ỿ -⁯₠-⃏℀-⅏←-⋿☀-➿\x{1F300}-\x{1F9FF}"
# Words in lines that are taken for code.
CODE_WORDS = ("function", "const ", "let ", "var ", "def ", "class ", "import ", "from ", "=>")
# Lines that are noise in screenshots.
SCREENSHOT_NOISE = (
    r"^[a-zA-Z0-9+/=_-]{20,}$", r"^\w{2,}=[a-zA-Z0-9+/=_-]{10,}$", r"^[A-Z]{6,}$", r"^[A-Z]{3,}[0-9]{2,}$", r"^[a-z]{3}-[a-z]{4}-[a-z]{3}$", r"^[a-zA-Z0-9]{8,}-[a-zA-Z0-9]{4,}", r"^[@#&%*+=<>]{2,}$", r"^[a-z]{1,2}$",
    r"^(Meet|Zoom|Teams)\s*-\s*[a-z]{3}-[a-z]{4}", r"^[xX+⋮⋯…×]{1,3}$", r"^\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)$", r"^(?:Online|Offline|Away|Busy)$", r"^[^\w\s]{1,2}$", r"^[a-zA-Z0-9]{1,2}[^\w\s]+$", r"^[aeiouy]{3,}$", r"^[^aeiouy]{5,}$",
    r"^\.{2,}$", r"^-{3,}$", r"^={3,}$", r"^[a-z]{1,3}\s*[0-9]{1,2}$", r"^[0-9]+[a-z]{1,2}$",
)
# Tags in order, and words of which a text has one; python also takes "import " with "python".
TAG_WORDS = (("code", ("function", "def ", "const ")), ("react", ("import react", "usestate", "jsx")), ("rust", ("fn ", "impl ", "struct ")), ("python", ("def ",)), ("async", ("async", "await")), ("note", ("todo", "note:")))
# Confidence of an answer that only names a category.
SIMPLE_CONFIDENCE = 0.75
