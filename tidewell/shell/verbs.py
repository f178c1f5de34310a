"""What programs do with their arguments, and what kind of work a command is (tables of fixed values)."""

from __future__ import annotations

import re

# Programs by what they do with their operands.
READ = [
    "cat", "bat", "head", "tail", "less", "more", "wc", "nl", "od", "xxd", "hexdump", "strings", "file", "stat", "du", "md5sum", "sha1sum",
    "sha256sum", "sha512sum", "md5", "shasum", "cksum", "sort", "uniq", "cut", "column", "base64", "diff", "cmp", "comm", "ls", "tree", "readlink",
    "realpath", "paste", "openssl", "ffprobe", "zstd", "unzstd", "zstdcat",
]
SEARCH = ["grep", "egrep", "fgrep", "rg", "ag", "ack"]
STREAM = ["sed", "awk", "gawk", "jq", "yq", "perl"]
REMOVE = ["rm", "shred", "unlink"]
WRITE = ["touch", "truncate", "tee", "chmod", "chown", "chgrp"]
COPY = ["cp", "install", "ln", "rsync", "scp"]
CHECK = [
    "ruff", "biome", "prettier", "eslint", "stylelint", "ktlint", "black", "isort", "mypy", "pytest", "shellcheck", "pyright", "clang-format", "tsc",
    "vitest", "playwright",
]
SHELLS = ["bash", "sh", "zsh", "dash", "ksh"]
FETCH = {
    "curl": ["-o", "--output"],
    "wget": ["-O", "--output-document"],
    "screen": ["hardcopy", "-Logfile"],
}
# Programs that convert: flags before what is read, and before what is written.
CONVERT = {
    "ffmpeg": (["-i"], []),
    "dhall-to-json": (["--file"], ["--output"]),
    "dhall-to-yaml": (["--file"], ["--output"]),
    "json-to-dhall": (["--file"], ["--output"]),
    "yaml-to-dhall": (["--file"], ["--output"]),
}
FIXES = ["--fix", "--fix-only", "--write", "-F", "--format", "-u", "--update", "--update-snapshots"]
# Flags that take a value, by program.
VALUED = {
    "head": ["-n", "-c"],
    "tail": ["-n", "-c"],
    "cut": ["-d", "-f", "-c"],
    "sort": ["-k", "-t", "-o"],
    "column": ["-t", "-s"],
    "base64": ["-w"],
    "diff": ["-U", "-x"],
    "tree": ["-L", "-I"],
    "du": ["-d"],
    "grep": ["-e", "-f", "-A", "-B", "-C", "-m", "--regexp", "--file", "--include", "--exclude", "--exclude-dir"],
    "rg": ["-e", "-f", "-A", "-B", "-C", "-m", "-g", "-t", "-T", "--regexp", "--file", "--glob", "--type"],
    "sed": ["-e", "-f", "--expression"],
    "awk": ["-F", "-v", "-f", "--file"],
    "gawk": ["-F", "-v", "-f", "--file"],
    "jq": ["--arg", "--argjson", "-f", "--from-file"],
    "yq": ["--arg", "-f"],
    "perl": ["-e", "-E", "-I", "-M", "-F"],
    "cp": ["--exclude"],
    "rsync": ["--exclude", "--include", "--filter", "-e"],
    "scp": ["-i", "-P"],
    "truncate": ["-s"],
    "touch": ["-d", "-t", "-r"],
    "find": ["-name", "-iname", "-path", "-type", "-maxdepth", "-mindepth", "-size", "-mtime", "-newer"],
    "fd": ["-e", "-t", "-d"],
    "pytest": ["-k", "-p", "-m"],
    "mypy": ["--config-file", "-p"],
    "ruff": ["--config", "--select", "--ignore"],
    "black": ["--line-length"],
    "curl": ["-H", "-d", "-X", "-u", "-o", "--output", "--data", "--header"],
    "wget": ["-O"],
    "ssh": ["-i", "-p", "-o", "-l", "-F", "-L", "-R"],
    "docker": ["-e", "-u", "-w"],
    "kubectl": ["-n", "-c"],
}
# Programs that run another, and those of their flags that take a value.
WRAPPERS = {
    "sudo": ["-u", "-g"],
    "env": ["-C", "-u"],
    "timeout": [],
    "nice": [],
    "ionice": [],
    "nohup": [],
    "setsid": [],
    "time": [],
    "command": [],
    "exec": [],
    "stdbuf": [],
    "builtin": [],
    "xargs": ["-I", "-n", "-P", "-d", "-a"],
    "npx": [],
    "pnpx": [],
    "bunx": [],
    "!": [],
}

# Kinds of work by program and first argument, then by program alone, where the operation alone doesn't tell it.
BY_SUB = [
    (["cargo", "npm", "pnpm", "yarn", "bun"], ["test"], "test"),
    (["cargo"], ["clippy", "fmt"], "check"),
    (["cargo", "npm", "pnpm", "yarn"], ["build"], "build"),
    (["cargo", "npm", "pnpm", "yarn", "bun"], ["add", "install", "update", "i"], "install"),
    (["cargo", "npm", "pnpm"], ["run"], "run"),
    (["nix"], ["build", "develop"], "build"),
    (["nix"], ["flake"], "install"),
    (["nix"], ["run"], "run"),
    (["kubectl"], ["apply", "rollout", "delete", "create", "patch", "scale"], "deploy"),
    (["docker", "podman"], ["push", "build"], "deploy"),
    (["go"], ["test"], "test"),
    (["go"], ["build"], "build"),
    (["adb"], ["install", "uninstall", "push"], "deploy"),
    (["gh"], ["run", "api", "status"], "observe"),
]
BY_NAME = {
    "version control": ["git", "gh"],
    "test": ["pytest", "vitest", "jest", "playwright", "ctest", "nextest"],
    "build": [
        "cargo", "npm", "pnpm", "yarn", "go", "gradlew", "gradle", "tsc", "ng", "cmake", "make", "javac", "kotlinc", "swift", "rustc", "lake",
        "esbuild", "vite", "webpack", "nix-build",
    ],
    "check": ["clippy", "ast-grep"],
    "deploy": ["helm", "nixos-rebuild", "home-manager", "flyctl", "tofu", "terraform", "k3s", "k3d", "flux", "argocd"],
    "observe": [
        "kubectl", "docker", "podman", "journalctl", "systemctl", "dmesg", "ping", "dig", "nc", "wg", "lsof", "ps", "top", "df", "uptime",
        "system_profiler", "launchctl", "printenv", "env", "nixos-version", "mount", "screen", "curl", "wget", "adb", "pgrep", "pkill", "killall",
        "kill", "netstat", "ifconfig", "traceroute", "host", "whois", "iostat", "vm_stat", "sw_vers", "diskutil", "networksetup", "ssh", "scp",
        "rsync", "sftp", "restic", "borg", "rclone", "probe",
    ],
    "install": ["pip", "pip3", "uv", "poetry", "brew", "nix-env", "nix-channel", "direnv", "npx", "corepack"],
    "query": ["mariadb", "mysql", "psql", "sqlite3", "redis-cli", "mongosh"],
    "run": [
        "perl", "ffmpeg", "xcrun", "osascript", "xargs", "tar", "unzip", "zip", "gzip", "openssl", "tsx", "resvg", "convert", "sips", "qpdf", "pandoc",
    ],
    "navigate": [
        "cd", "ls", "pwd", "echo", "printf", "mkdir", "which", "whoami", "date", "sleep", "tree", "clear", "export", "source", "open", "hostname",
        "uname", "id", "basename", "dirname", "realpath", "readlink", "touch", "chmod",
    ],
    "inspect": ["tr", "rev", "tee"],
    "search": ["find", "fd", "locate"],
    "not work": [
        "for", "do", "done", "then", "else", "elif", "if", "fi", "while", "until", "case", "esac", "in", "break", "continue", "return", "exit", "seq",
        "true", "false", ":", "[", "[[", "test", "eval", "set", "unset", "read", "wait", "trap", "shift", "local", "function", "yes", "sync", "type",
        "hash", "disown", "jobs", "su", "sudo", "exec", "command", "builtin", "alias",
    ],
}
_NAME = {n: kind for kind, names in BY_NAME.items() for n in names}
_SUB = {(n, s): kind for names, subs, kind in BY_SUB for n in names for s in subs}


def is_assignment(word: str) -> bool:
    return bool(re.match(r"[A-Za-z_][A-Za-z0-9_]*\+?=", word))


def unwrap(argv: list[str]) -> list[str]:
    """Without assignments and wrappers in front."""
    while argv:
        if is_assignment(argv[0]):
            argv = argv[1:]
            continue
        name = argv[0].rsplit("/", 1)[-1]
        if name not in WRAPPERS or len(argv) == 1:
            return argv
        valued, rest = WRAPPERS[name], argv[1:]
        while rest and rest[0].startswith("-"):
            rest = rest[2:] if rest[0] in valued else rest[1:]
        if name in ("timeout", "nice") and rest and re.fullmatch(r"[0-9.]+[smhd]?", rest[0]):
            rest = rest[1:]
        argv = rest
    return argv


def operands(argv: list[str], name: str) -> tuple[list[str], dict[str, list[str]]]:
    """Positional words, and values of flags."""
    valued, out, flags, rest = set(VALUED.get(name, [])), [], {}, False
    i = 1
    while i < len(argv):
        w = argv[i]
        if rest or not w.startswith("-") or w == "-":
            out.append(w)
        elif w == "--":
            rest = True
        elif w in valued:
            flags.setdefault(w, []).append(argv[i + 1] if i + 1 < len(argv) else "")
            i += 1
        elif w.startswith("--") and "=" in w:
            k, v = w.split("=", 1)
            flags.setdefault(k, []).append(v)
        else:
            flags.setdefault(w, []).append("")
        i += 1
    return out, flags


def activity(argv: list[str], writes_redirect: bool, kind: str) -> str:
    """Kind of work: writing redirects and editing operations first, then the tables, then the operation."""
    if writes_redirect or kind in ("write", "remove", "copy", "move", "in-place", "git-alter"):
        return "edit"
    if kind == "search":
        return "search"
    argv = unwrap(argv)
    if not argv:
        return "not work"
    name, sub = argv[0].rsplit("/", 1)[-1], argv[1] if len(argv) > 1 else ""
    if name in ("gradlew", "gradle") and any(re.search("[Tt]est|spec", w) for w in argv[1:]):
        return "test"
    return _SUB.get((name, sub)) or _NAME.get(name) or {"read": "inspect", "stream": "inspect", "walk": "search", "check": "check", "run": "run", "git": "version control", "remote": "observe", "cd": "navigate"}.get(kind, name)
