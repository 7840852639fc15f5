"""Settings of a project and of a user, and where a project begins. All of this is small and stays on the driver."""

from __future__ import annotations

import json
import os

# The settings of a project file and the thresholds that they change; the keys of a user's settings.
THRESHOLDS = {
    "deep_nesting": {"warning": "nesting_w", "alert": "nesting_a"},
    "brain_method": {"warning_lines": "func_loc_w", "alert_lines": "func_loc_a"},
    "file_bloat": {"warning_lines": "file_loc_w", "alert_lines": "file_loc_a"},
    "cyclomatic_complexity": {"warning": "func_cc_w", "alert": "func_cc_a"},
    "bumpy_road": {"bumps_warning": "bumps"},
    "long_parameter_list": {"warning": "args_w", "alert": "args_a"},
    "complex_conditional": {"branches_warning": "conditional_w", "branches_alert": "conditional_a"},
    "lazy_element": {"min_lines": "lazy"},
    "paragraph_of_code": {"max_consecutive": "paragraph"},
    "excessive_comments": {"ratio": "comments"},
    "global_data": {"warning": "globals_"},
    "long_scope_variable": {"min_lines": "long_scope"},
    "long_switch": {"warning": "switch_w", "alert": "switch_a"},
    "duplicated_code": {"min_lines": "dup_lines", "min_similarity": "dup_similarity"},
}
KEYS = ("access_token", "onprem_url", "default_path", "language", "repo_path", "enabled_tools", "read_only", "disable_git")
# End of fixed values.


def overrides(settings: dict) -> dict[str, float]:
    """The thresholds that the rules of a project file set, for ``config.thresholds``; what isn't a positive number changes nothing."""
    found = {}
    rules = settings.get("rules", {})
    for rule, keys in THRESHOLDS.items():
        given = rules.get(rule) if isinstance(rules, dict) else None
        for key, name in keys.items():
            value = given.get(key) if isinstance(given, dict) else None
            if isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0:
                found[name] = value
    return found


def exclusions(settings: dict) -> list[str]:
    """The paths that a project file leaves out."""
    section = settings.get("exclude", {})
    return [x for x in section.get("files", []) if isinstance(x, str)] if isinstance(section, dict) else []


def read_user(path: str) -> dict:
    """A user's settings, {} without a file. A file that is no JSON is an error."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def shown(settings: dict) -> dict:
    """Settings as they may be shown: without the token itself."""
    return {k: "***" if k == "access_token" and v else v for k, v in settings.items()}


def set_user(path: str, key: str, value: str) -> dict:
    """Change one key of a user's settings, write them, and return them as they may be shown."""
    if key not in KEYS:
        raise ValueError(f"unknown config key: {key} (valid: {', '.join(KEYS)})")
    settings = read_user(path)
    settings[key] = value in ("true", "1") if key in ("read_only", "disable_git") else [x.strip() for x in value.split(",") if x.strip()] if key == "enabled_tools" else value
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2)
    return shown(settings)


def repository(start: str) -> str | None:
    """The nearest folder from ``start`` upwards that holds version control's own folder or file; None without one."""
    folder = os.path.abspath(start)
    while not os.path.exists(os.path.join(folder, ".git")):
        if os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)
    return folder


def guarded(path: str, root: str) -> str:
    """The real path of ``path``, which must be ``root`` or lie below it, links resolved."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise PermissionError(f"access denied: path '{path}' is outside the working directory")
    return real
