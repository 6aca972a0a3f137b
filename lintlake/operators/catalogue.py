"""Rule catalogue: what each kind of finding says.

Every finding kind is one row of constants. Operators emit small evidence rows (a catalogue
index plus line, count, name and line text); `issues.render` joins the constants back as a
literal lookup, so the hot path moves integers and not text.

Placeholders: {file} path, {line} 1-based line, {i} 0-based line, {n} count, {name} captured
name, {const} the name as an environment variable, {trim} trimmed line, {red} redacted line,
{after} rewritten line.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Kind:
    key: str
    rule: str
    category: str
    severity: str
    title: str
    description: str
    id: str
    fix: str | None = None
    automated: bool = False
    before: str | None = None
    after: str | None = None
    effort: str = "easy"
    impact: str = "medium"
    tags: tuple = ()
    references: tuple = ()
    cat: int = 0  # place of the category in the emission order
    phase: int = 0  # place of the block inside the category
    grp: int = 0  # place of the rule inside one file
    bump_over: int | None = None  # a count above this ...
    bump_to: str | None = None  # ... raises the severity to this


# ---- fixed values: patterns -----------------------------------------------------------------

# name, pattern, ignore case, severity
SECRETS = (
    ("AWS Access Key", r"(?:AKIA|AIPA|ASIA|AROA)[A-Z0-9]{16}", False, "critical"),
    ("AWS Secret Key", r"aws[_\-\s]?secret[_\-\s]?(?:access[_\-\s]?)?key\s*[=:]\s*['\"]?[A-Za-z0-9/+=]{40}['\"]?", True, "critical"),
    ("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", False, "critical"),
    ("GitHub Token", r"gh[opsu]_[A-Za-z0-9_]{36,}", False, "critical"),
    ("Stripe Secret Key", r"sk_live_[0-9a-zA-Z]{24,}", False, "critical"),
    ("Stripe Publishable Key", r"pk_live_[0-9a-zA-Z]{24,}", False, "high"),
    ("Generic API Key", r"(?:api[_\-]?key|apikey)\s*[=:]\s*['\"]([A-Za-z0-9\-_]{20,})['\"]?", True, "high"),
    ("JWT Secret", r"jwt[_\-]?secret\s*[=:]\s*['\"](.{10,})['\"]?", True, "critical"),
    ("Database Password", r"(?:db|database|mysql|postgres|mongo|redis)[_\-]?(?:pass|password|pwd)\s*[=:]\s*['\"](.{6,})['\"]?", True, "critical"),
    ("Database Connection String", r"(?:mongodb|postgres|mysql|redis)://[^:]+:[^@]+@", True, "critical"),
    ("Private Key Header", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", False, "critical"),
    # Written without look-ahead, so that one text serves Java and RE2; the meaning is the same. The
    # class has no dot, so a value read from `process.env` cannot match.
    ("Hardcoded Password Variable", r"(?:password|passwd|pwd)\s*=\s*['\"][A-Za-z0-9!@#$%^&*()_+]{6,}['\"]", True, "high"),
    ("SendGrid API Key", r"SG\.[A-Za-z0-9\-_]{22}\.[A-Za-z0-9\-_]{43}", False, "critical"),
    ("Slack Token", r"xox[baprs]-(?:[A-Za-z0-9-]+)", False, "high"),
    ("Firebase Config", r"firebaseConfig\s*=\s*\{[\s\S]*?apiKey\s*:\s*['\"][A-Za-z0-9\-_]+['\"]", True, "high"),
)
SQL_INJECTION = (
    r"(?:query|execute|run)\s*\(\s*[`'\"]\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?\$\{",
    r"(?:query|execute|run)\s*\(\s*['\"`]\s*.*?'\s*\+\s*(?:req\.|params\.|query\.)",
    r"\bexec(?:Sync)?\s*\(`[^`]*\$\{[^}]+\}`\s*\)",
)  # all ignore case
XSS = (
    # Written without look-ahead, so that one text serves Java and RE2; the meaning is the same.
    # `innerHTML=''` is exempt only without a space, because the run of spaces backtracks.
    r"innerHTML\s*=(?:\s|[^'\"`\s]|\z|['\"`]\s*(?:[^'\"`\s]|\z))",
    r"outerHTML\s*=",
    r"document\.write\s*\(",
    r"\$\(.*?\)\.html\s*\(",
    r"dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html",
)
COMMAND_INJECTION = (
    (r"(?:exec|execSync|spawn|spawnSync)\s*\(\s*(?:[`'\"].*?\$\{|.*?\+\s*(?:req\.|params\.|query\.))", True),
    (r"child_process.*exec\s*\(.*\+", False),
)
UNSAFE_EVAL = (
    r"\beval\s*\(",
    r"new\s+Function\s*\(",
    r"setTimeout\s*\(\s*['\"`]",
    r"setInterval\s*\(\s*['\"`]",
)
CONSOLE = r"\bconsole\.(log|debug|info)\s*\("
TODO = r"//\s*(?:TODO|FIXME|HACK|XXX|TEMP|BUG)(?:\s*:|\s+)"
DEBUGGER = r"\bdebugger\b"
NESTED_LOOP = r"for\s*\([^)]+\)\s*\{[^}]*for\s*\([^)]+\)\s*\{"
FUNCTION_NAME = r"(?:function\s+|const\s+)(\w+)\s*(?:=\s*(?:async\s+)?\(|\()"
API_CALL = r"(?:fetch|axios\.get|axios\.post)\s*\(\s*['\"`]([^'\"` ]+)['\"`]"
PAGE_IMPORT = r"import\s+\w+\s+from\s+['\"].*(?:Page|Route|View|Screen)"
TEST_BLOCK = r"\b(?:it|test)\s*\([^,]+,\s*(?:async\s*)?\(\)\s*=>\s*\{([^}]*)\}"
COMPLEXITY = (
    r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b",
    r"\?\s*[^:]", r"&&", r"\|\|", r"\?\?",
)
# name, pattern, ignore case
DESIGN_PATTERNS = (
    ("Singleton", r"private\s+static\s+instance|getInstance\s*\(\)", False),
    ("Factory", r"createInstance|Factory\s*\{|factory\s*\(", True),
    ("Repository", r"Repository\s*\{|interface\s+\w+Repository", False),
    ("Observer", r"subscribe|unsubscribe|EventEmitter|Subject", False),
    ("Decorator", r"@\w+\s*\n.*class\s+", False),
    ("Strategy", r"interface\s+\w+Strategy|Strategy\s*\{", False),
)
CRITICAL_MODULES = (
    "auth", "login", "register", "password", "payment", "checkout", "database", "db", "api",
    "middleware", "controller", "service", "repository",
)
# package, weight, alternative
HEAVY_DEPENDENCIES = (
    ("moment", "67 KB", "date-fns or dayjs"),
    ("lodash", "71 KB", "lodash-es or native methods"),
    ("jquery", "87 KB", "vanilla JS"),
    ("bootstrap/dist/js/bootstrap.bundle", "60 KB", "component libraries"),
    ("rxjs", "200 KB", "only import needed operators"),
    ("three/build/three", "580 KB", "import specific modules"),
)

# ---- fixed values: texts of the findings ------------------------------------------------------

_OWASP = "https://owasp.org/www-community/"
_WCAG = "https://www.w3.org/WAI/WCAG21/Understanding/"

QUALITY = (
    Kind("max-file-size", "max-file-size", "quality", "medium", "Large File",
         "File has {n} lines. Files over 500 lines are hard to maintain.",
         "quality-large-file-{file}", "Split into smaller, focused modules",
         effort="medium", grp=0, bump_over=1000, bump_to="high"),
    Kind("no-console", "no-console", "quality", "low", "Console Statement",
         "Remove debug console statements before production.", "quality-console-log-{file}-{i}",
         "Remove or replace with a proper logger", True, "{trim}", "// use a logger instead",
         effort="trivial", impact="low", grp=1),
    Kind("no-debugger", "no-debugger", "quality", "medium", "Debugger Statement",
         "Debugger statement left in production code.", "quality-debugger-{file}-{i}",
         "Remove the statement", True, "{trim}", "", effort="trivial", impact="low", grp=1),
    Kind("no-todo", "no-todo", "quality", "info", "TODO / FIXME Comment",
         "Unresolved TODO or FIXME comment.", "quality-todo-{file}-{i}", impact="low", grp=1),
    Kind("max-depth", "max-depth", "quality", "medium", "Deep Nesting",
         "Maximum nesting depth of {n} detected. Aim for ≤ 4.", "quality-deep-nesting-{file}",
         "Extract deeply nested blocks into separate functions",
         effort="medium", grp=2, bump_over=7, bump_to="high"),
    Kind("max-lines-per-function", "max-lines-per-function", "quality", "medium", "Long Function",
         'Function "{name}" has {n} lines. Max recommended: 50.',
         "quality-long-method-{file}-{line}",
         "Break into smaller, single-responsibility functions",
         effort="medium", grp=3, bump_over=100, bump_to="high"),
    Kind("complexity", "complexity", "quality", "medium", "High Cyclomatic Complexity",
         'Function "{name}" has complexity {n}. Max recommended: 10.',
         "quality-complexity-{file}-{line}",
         "Extract branches into separate functions or use strategy pattern",
         effort="hard", impact="high", grp=3, bump_over=20, bump_to="high",
         references=("https://en.wikipedia.org/wiki/Cyclomatic_complexity",)),
    Kind("no-unused-vars", "no-unused-vars", "quality", "low", "Unused Variable",
         'Variable "{name}" is declared but never used.', "quality-unused-var-{file}-{line}",
         'Remove or prefix with "_" to suppress: _{name}', True,
         effort="trivial", impact="low", grp=5),
    Kind("no-explicit-any", "no-explicit-any", "quality", "low", "Explicit `any` Type",
         '{n} use(s) of "any" type detected. Use proper types for type safety.',
         "quality-any-type-{file}", "Replace `any` with the correct type or `unknown`", grp=6),
    Kind("no-duplicate-functions", "no-duplicate-functions", "quality", "medium",
         "Duplicate Function Name", 'Function "{name}" is defined more than once in this file.',
         "quality-duplicate-fn-{file}-{name}",
         "Remove duplicate definitions or rename to clarify intent", grp=7),
)

SECURITY = (
    *(
        Kind(f"secret-{k}", "no-hardcoded-secrets", "security", severity, f"Hardcoded {name}",
             f"Potential hardcoded {name} detected. Never commit credentials to source control.",
             f"security-secret-{name.replace(' ', '-').lower()}-{{file}}-{{i}}",
             f"Move to environment variable: process.env.{name.replace(' ', '_').upper()}",
             False, "{red}",
             f"const value = process.env.{name.replace(' ', '_').upper()} ?? '';",
             impact="high", tags=("secrets", "credentials"), cat=1, grp=k,
             references=(_OWASP + "vulnerabilities/Use_of_hard-coded_password",))
        for k, (name, _, _, severity) in enumerate(SECRETS)
    ),
    *(
        Kind(f"sql-{k}", "no-sql-injection", "security", "critical", "SQL Injection Risk",
             "Dynamic SQL query constructed with user input. Use parameterized queries.",
             "security-sql-injection-{file}-{i}", "Use parameterized queries or an ORM", False,
             "{trim}", "db.query('SELECT * FROM users WHERE id = ?', [userId])",
             effort="medium", impact="high", references=(_OWASP + "attacks/SQL_Injection",),
             cat=1, grp=15 + k)
        for k in range(len(SQL_INJECTION))
    ),
    *(
        Kind(f"xss-{k}", "no-xss", "security", "high", "XSS Risk",
             "Unsanitized HTML injection detected.", "security-xss-{file}-{i}",
             "Use DOMPurify or textContent instead of innerHTML", False, "{trim}",
             "element.textContent = userInput; // or DOMPurify.sanitize(input)",
             effort="medium", impact="high", references=(_OWASP + "attacks/xss/",),
             cat=1, grp=18 + k)
        for k in range(len(XSS))
    ),
    *(
        Kind(f"command-{k}", "no-command-injection", "security", "critical",
             "Command Injection Risk", "Shell command constructed with user input.",
             "security-cmd-injection-{file}-{i}",
             "Validate and sanitize input, avoid shell=true",
             effort="medium", impact="high", references=(_OWASP + "attacks/Command_Injection",),
             cat=1, grp=23 + k)
        for k in range(len(COMMAND_INJECTION))
    ),
    *(
        Kind(f"eval-{k}", "no-eval", "security", "high", "Unsafe eval() Usage",
             "eval() or equivalent executes arbitrary code and is a security risk.",
             "security-eval-{file}-{i}",
             "Replace eval() with safe alternatives (JSON.parse, Function constructors avoided)",
             False, "{trim}", "// use JSON.parse() for data, or restructure logic",
             effort="medium", impact="high", cat=1, grp=25 + k,
             references=("https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/"
                         "Global_Objects/eval#never_use_eval!",))
        for k in range(len(UNSAFE_EVAL))
    ),
    Kind("csrf-protection", "csrf-protection", "security", "medium",
         "Possible Missing CSRF Protection",
         "Mutating route detected without visible CSRF protection middleware.",
         "security-csrf-{file}", "Add csrf middleware (e.g., csurf or double-csrf)",
         references=(_OWASP + "attacks/csrf",), cat=1, grp=29),
)

PERFORMANCE = (
    *(
        Kind(f"heavy-{k}", "heavy-dependencies", "performance", "medium",
             f"Heavy Dependency: {name}",
             f'"{name}" adds ~{weight} to your bundle. Consider: {instead}',
             f"perf-heavy-dep-{name}", f"Replace with {instead}", effort="medium",
             cat=2, phase=0, grp=k)
        for k, (name, weight, instead) in enumerate(HEAVY_DEPENDENCIES)
    ),
    Kind("no-nested-loops", "no-nested-loops", "performance", "medium",
         "Nested Loop (O(n²) or worse)",
         "Nested loops can cause performance degradation with large datasets.",
         "perf-nested-loop-{file}", "Use Map/Set for O(1) lookups, or restructure the algorithm",
         effort="hard", impact="high", cat=2, phase=1, grp=0),
    Kind("react-memo", "react-memo", "performance", "low", "Missing React.memo",
         "Large component without React.memo may cause unnecessary re-renders.",
         "perf-missing-memo-{file}", "Wrap the component export with React.memo()", True,
         "export default function MyComponent(props) { ... }",
         "export default React.memo(function MyComponent(props) { ... })",
         effort="trivial", cat=2, phase=1, grp=1),
    Kind("exhaustive-deps", "react-hooks/exhaustive-deps", "performance", "medium",
         "Possible Stale Closure in useEffect",
         "useEffect with empty deps may capture stale values.", "perf-stale-closure-{file}-{i}",
         "Add proper dependencies to the useEffect dependency array", cat=2, phase=1, grp=2),
    Kind("react-usememo", "react-usememo", "performance", "low",
         "Consider useMemo for Expensive Computations",
         "Chained array operations without useMemo recalculate on every render.",
         "perf-missing-usememo-{file}", "Wrap expensive derived computations in useMemo()", False,
         "const result = items.filter(...).map(...)",
         "const result = useMemo(() => items.filter(...).map(...), [items])",
         cat=2, phase=1, grp=3),
    Kind("react-lazy-routes", "react-lazy-routes", "performance", "low",
         "Missing Route Lazy Loading",
         "Page/Route component imported synchronously. Use React.lazy() for code splitting.",
         "perf-missing-lazy-{file}-{i}",
         "Use React.lazy() or Next.js dynamic() for page components", False, "{trim}",
         "const {name} = React.lazy(() => import('...'))", cat=2, phase=1, grp=4),
    Kind("no-duplicate-api-calls", "no-duplicate-api-calls", "performance", "medium",
         "Duplicate API Call",
         'URL "{name}" is fetched multiple times. Consider caching with SWR/React Query.',
         "perf-duplicate-api-{file}-{name}",
         "Use SWR, React Query, or a shared cache to deduplicate requests",
         effort="medium", cat=2, phase=1, grp=5),
    Kind("no-sync-fs", "no-sync-fs", "performance", "medium",
         "Synchronous File System Operation", "Synchronous fs operations block the event loop.",
         "perf-sync-fs-{file}-{i}", "Use async alternatives: fs.readFile(), fs.writeFile(), etc.",
         False, "{trim}", "{after} // use await", cat=2, phase=1, grp=6),
)

ACCESSIBILITY = (
    Kind("img-alt", "img-alt", "accessibility", "high", "Missing alt Attribute on <img>",
         "Images must have alt text for screen readers.", "a11y-img-alt-{file}-{line}",
         'Add descriptive alt attribute, or alt="" for decorative images', True,
         "{trim}", "{after}", "trivial", "high", references=(_WCAG + "non-text-content.html",),
         cat=3),
    Kind("label-for-input", "label-for-input", "accessibility", "high", "Input Missing Label",
         "Form inputs must have associated labels for accessibility.",
         "a11y-input-label-{file}-{line}",
         "Add aria-label, aria-labelledby, or associate a <label> element", True,
         "{trim}", "{after}", "trivial", "high",
         references=(_WCAG + "labels-or-instructions.html",), cat=3),
    Kind("interactive-element-semantics", "interactive-element-semantics", "accessibility",
         "medium", "Non-Semantic Interactive Element",
         'Clickable <div> without role="button". Use <button> or add role + tabIndex.',
         "a11y-div-button-{file}-{line}",
         'Replace <div onClick> with <button> or add role="button" tabIndex={0}', False,
         "{trim}", "{after}", "easy", "medium",
         references=("https://www.w3.org/WAI/ARIA/apg/patterns/button/",), cat=3),
    Kind("button-aria-label", "button-aria-label", "accessibility", "medium",
         "Icon-Only Button Missing aria-label",
         "Button with no visible text needs aria-label for screen readers.",
         "a11y-button-label-{file}-{line}", "Add aria-label to the <button> element", True,
         "{trim}", "{after}", "trivial", "medium", cat=3),
    Kind("html-has-lang", "html-has-lang", "accessibility", "medium",
         "Missing lang Attribute on <html>",
         "The <html> element must have a lang attribute to help screen readers.",
         "a11y-html-lang-{file}-{line}", 'Add lang attribute: <html lang="en">', True,
         "{trim}", "{after}", "trivial", "medium",
         references=(_WCAG + "language-of-page.html",), cat=3),
    Kind("heading-order", "heading-order", "accessibility", "low", "Heading Level Skip",
         "<h{n}> used without a preceding <h{name}>. Keep heading hierarchy sequential.",
         "a11y-heading-skip-{file}-{line}",
         "Use headings in order: h1 → h2 → h3. Don't skip levels for styling.",
         impact="low", cat=3),
    Kind("focus-visible", "focus-visible", "accessibility", "medium", "Removed Focus Outline",
         "Removing outline without a focus-visible replacement breaks keyboard navigation.",
         "a11y-outline-none-{file}-{line}",
         "Use :focus-visible pseudo-class to provide visible keyboard focus", False,
         "outline: none", ":focus-visible { outline: 2px solid #0ea5e9; }",
         impact="high", cat=3),
)

TESTING = (
    Kind("no-untested-critical", "no-untested-critical", "testing", "high",
         "Critical Module Without Tests",
         '"{file}" appears to be a critical module (auth/db/payment) with no test file.',
         "testing-untested-critical-{file}", "Create test file: {name}",
         effort="hard", impact="high", cat=4, phase=0),
    Kind("missing-test", "require-tests", "testing", "low", "Missing Test File",
         'No test file found for "{file}".', "testing-missing-test-{file}", "Create: {name}",
         effort="medium", cat=4, phase=0),
    Kind("low-coverage", "min-coverage", "testing", "high", "Low Test Coverage",
         "Estimated test coverage: {n}%. Aim for ≥ 70%.", "testing-low-coverage",
         "Add unit tests for untested modules, especially critical ones",
         effort="hard", impact="high", cat=4, phase=1),
    Kind("medium-coverage", "min-coverage", "testing", "medium", "Moderate Test Coverage",
         "Estimated test coverage: {n}%. Recommended: ≥ 70%.", "testing-medium-coverage",
         "Add tests for uncovered modules", effort="hard", cat=4, phase=1),
    Kind("no-empty-tests", "no-empty-tests", "testing", "medium", "Empty Test File",
         'Test file "{file}" has no test cases.', "testing-empty-test-{file}",
         "Add actual test cases to this test file", effort="medium", cat=4, phase=2, grp=0),
    Kind("require-assertions", "require-assertions", "testing", "medium",
         "Test Without Assertion",
         "Test case found with no assertion (expect/assert/should).",
         "testing-no-assertion-{file}", "Add at least one expect() assertion per test case",
         cat=4, phase=2, grp=1),
    Kind("no-tests", "require-tests", "testing", "critical", "No Tests Found",
         "No test files found in the project. Testing is essential for maintainability.",
         "testing-no-framework",
         "Set up Vitest: npm install -D vitest && add test scripts",
         effort="hard", impact="high", cat=4, phase=3),
)

ARCHITECTURE = (
    Kind("src-directory", "src-directory", "architecture", "low", "No src/ Directory",
         "Source code not organized under a src/ directory.", "arch-no-src-dir",
         "Organize source files under a src/ directory",
         effort="medium", impact="low", cat=5, phase=0),
    Kind("no-circular-dependencies", "no-circular-dependencies", "architecture", "high",
         "Circular Dependency", "Circular import detected: {name}", "arch-circular-dep-{file}",
         "Extract shared logic into a third module to break the cycle",
         effort="hard", impact="high", cat=5, phase=1),
    Kind("layer-separation", "layer-separation", "architecture", "medium",
         "Layer Separation Violation",
         'Controller "{file}" imports data layer directly, skipping the service layer.',
         "arch-layer-violation-{file}",
         "Controllers should only import services; data access goes in repositories",
         effort="hard", impact="high", cat=5, phase=2),
    Kind("folder-structure", "folder-structure", "architecture", "medium",
         "Flat Project Structure",
         "{n} files in root/src with no sub-directory organization.", "arch-flat-structure",
         "Organize files into feature or layer directories (components/, services/, etc.)",
         effort="medium", cat=5, phase=3),
    Kind("module-size", "module-size", "architecture", "low", "Large Monolith Project",
         "{n} source files. Consider splitting into packages or modules.", "arch-large-project",
         "Consider a monorepo structure (Turborepo, Nx) or micro-frontends",
         effort="hard", cat=5, phase=4),
    Kind("require-readme", "require-readme", "architecture", "low", "Missing README.md",
         "No README.md found. Documentation is essential for maintainability.",
         "arch-missing-readme",
         "Create a README.md with setup instructions and architecture overview",
         impact="low", cat=5, phase=5),
    Kind("require-env-example", "require-env-example", "architecture", "medium",
         "Missing .env.example",
         ".env found but no .env.example. New developers cannot configure the project.",
         "arch-missing-env-example",
         "Create .env.example with all required variable keys (no values)",
         effort="trivial", cat=5, phase=6),
)

# Opt-in packs; they report under an existing category but come after all scanners.
REACT_PACK = (
    Kind("react-key", "react/key", "quality", "medium", "Missing key Prop in List",
         "List rendering without key prop causes React reconciliation issues.",
         "react-missing-key-{file}-{i}",
         "Add a unique key prop to the root element in each .map() callback", False,
         ".map((item) => <div>...</div>)", ".map((item) => <div key={item.id}>...</div>)",
         "trivial", "medium", cat=6),
    Kind("react-prop-drilling", "react-prop-drilling", "quality", "low",
         "Possible Prop Drilling",
         "{n} props accessed from props. Consider Context API or state management.",
         "react-prop-drilling-{file}-{i}",
         "Use React.createContext() or Zustand/Redux for shared state",
         effort="hard", cat=6),
    Kind("react-use-reducer", "react-use-reducer", "quality", "low",
         "Complex State with Multiple useState",
         "{n} useState calls. Consider useReducer for complex state logic.",
         "react-complex-state-{file}", "Consolidate related state with useReducer()",
         effort="medium", impact="low", cat=6),
)
NEXT_PACK = (
    Kind("next-img", "nextjs/no-img-element", "performance", "medium",
         "Use next/image Instead of <img>",
         "next/image provides automatic optimization, lazy loading, and WebP conversion.",
         "nextjs-img-component-{file}-{i}",
         "Replace <img> with Next.js <Image> component from 'next/image'", False, "{trim}",
         "import Image from 'next/image';\n<Image src=\"...\" width={} height={} alt=\"...\" />",
         cat=7),
    Kind("next-link", "nextjs/no-html-link-for-pages", "performance", "low",
         "Use next/link Instead of <a>",
         "next/link enables client-side navigation and prefetching.",
         "nextjs-link-component-{file}-{i}",
         "Replace <a href> with Next.js <Link> from 'next/link'", False, "{trim}",
         "import Link from 'next/link';\n<Link href=\"...\">text</Link>", impact="low", cat=7),
)
NODE_PACK = (
    Kind("node-promise", "no-unhandled-promise", "quality", "medium",
         "Unhandled Promise Rejection",
         "Promise chain without .catch() will silently swallow errors.",
         "node-unhandled-promise-{file}-{i}",
         "Add .catch(err => ...) or use try/catch with async/await", False, "{trim}",
         "{trim}\n.catch(err => console.error(err))", impact="high", cat=8),
    Kind("node-middleware", "express-error-middleware", "quality", "high",
         "Missing Express Error Middleware",
         "Express app without error-handling middleware (4-argument signature).",
         "node-missing-error-middleware-{file}",
         "Add: app.use((err, req, res, next) => { ... })", False, "app.listen(...)",
         "app.use((err, req, res, next) => {\n  res.status(500).json({ error: err.message });\n});"
         "\napp.listen(...)", impact="high", cat=8),
)

CATALOGUE: tuple[Kind, ...] = (
    *QUALITY, *SECURITY, *PERFORMANCE, *ACCESSIBILITY, *TESTING, *ARCHITECTURE,
    *REACT_PACK, *NEXT_PACK, *NODE_PACK,
)
INDEX = {kind.key: i for i, kind in enumerate(CATALOGUE)}


def kinds_of(category: str, rule: str | None = None) -> list[Kind]:
    return [k for k in CATALOGUE if k.category == category and rule in (None, k.rule)]
