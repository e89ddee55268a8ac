"""Small repositories with fixed authors and dates."""

import os
import subprocess


class Repo:
    def __init__(self, path):
        self.path = str(path)
        self.clock = 1_700_000_000
        self.git("init", "-q", "-b", "main")

    def git(self, *args, when=None):
        stamp = f"{when or self.clock} +0200"
        env = {
            **os.environ,
            "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x", "GIT_COMMITTER_NAME": "Ann",
            "GIT_COMMITTER_EMAIL": "ann@x", "GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp,
            "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null",
        }
        done = subprocess.run(["git", "-C", self.path, *args], env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        return done.stdout.strip()

    def write(self, name, content):
        full = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        mode = "wb" if isinstance(content, bytes) else "w"
        with open(full, mode) as out:
            out.write(content)

    def commit(self, message, files=None, remove=(), move=()):
        for name, content in (files or {}).items():
            self.write(name, content)
        for old, new in move:
            os.makedirs(os.path.dirname(os.path.join(self.path, new)) or self.path, exist_ok=True)
            self.git("mv", old, new)
        for name in remove:
            self.git("rm", "-q", name)
        self.git("add", "-A")
        self.clock += 86_400
        self.git("commit", "-q", "--allow-empty", "-m", message)
        return self.git("rev-parse", "HEAD")
