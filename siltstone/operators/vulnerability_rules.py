"""The vulnerability rules."""

from __future__ import annotations

from dataclasses import dataclass

# Extension groups and rules that findings must agree with.

JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte")
PY = (".py", ".pyi", ".ipynb")
DOC = (".md", ".mdx", ".txt", ".rst", ".json", ".yaml", ".yml")
GO = (".go",)


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    severity: str
    pattern: str = ""
    literals: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    unless: str = ""


RULES = (
    Rule("pull_request_target", "workflow", "critical", r"pull_request_target\s*:"),
    Rule("child_process_exec", "injection", "critical", r"child_process\.exec|execSync\(", ("exec(",), JS),
    Rule("new_function_injection", "injection", "critical", literals=("new Function",)),
    Rule("eval_injection", "injection", "critical", r"\beval\(", never=DOC),
    Rule("os_system_injection", "injection", "critical", r"\bos\.system\s*\(", ("from os import system",), PY),
    Rule("python_subprocess_shell", "injection", "critical", r"subprocess\.(?:run|call|Popen|check_output|check_call)\(.*shell\s*=\s*True"),
    Rule("go_exec_shell_injection", "injection", "critical", r'exec\.Command\(\s*"(?:sh|bash|/bin/sh|/bin/bash)"'),
    Rule("os_popen_injection", "injection", "critical", r"\bos\.popen\s*\(", only=PY),
    Rule("python_exec_injection", "injection", "critical", r"\bexec\s*\(", only=PY),
    Rule("python_subprocess_without_shell", "injection", "warning", r"subprocess\.(?:run|call|Popen|check_output|check_call)\s*\(", only=PY, unless=r"shell\s*=\s*True"),
    Rule("react_dangerously_set_html", "xss", "critical", literals=("dangerouslySetInnerHTML",)),
    Rule("document_write_xss", "xss", "critical", literals=("document.write",)),
    Rule("innerHTML_xss", "xss", "critical", literals=(".innerHTML =", ".innerHTML=")),
    Rule("outerHTML_xss", "xss", "critical", literals=(".outerHTML =", ".outerHTML=")),
    Rule("insertAdjacentHTML_xss", "xss", "critical", literals=(".insertAdjacentHTML(",)),
    Rule("script_src_without_sri", "xss", "warning", r"<script\s[^>]*src\s*=\s*['\x22](?:https?:)?//[^'\x22]{1,300}['\x22][^>]*>", unless=r"integrity\s*="),
    Rule("django_mark_safe_xss", "xss", "critical", literals=("mark_safe(", "SafeString", "format_html("), only=PY),
    Rule("flask_render_template_string_xss", "xss", "critical", literals=("render_template_string(", "Markup("), only=PY),
    Rule("jinja2_autoescape_disabled", "xss", "alert", r"\bautoescape\s*=\s*False\b", only=PY),
    Rule("go_template_html_xss", "xss", "alert", r"\btemplate\.HTML\s*\(|\btemplate\.JS\s*\(|\btemplate\.URL\s*\(", only=GO),
    Rule("go_template_html_attr_xss", "xss", "alert", r"\btemplate\.HTMLAttr\s*\(|\btemplate\.CSS\s*\(|\btemplate\.Srcset\s*\(", only=GO),
    Rule("pickle_deserialization", "deserialization", "critical", r"\bpickle\.(loads?|Unpickler)\b|\bpkl_load\(", only=PY),
    Rule("unsafe_yaml_load", "deserialization", "critical", r"\byaml\.(load|load_all)\s*\("),
    Rule("marshal_loads", "deserialization", "critical", r"\bmarshal\.loads?\s*\("),
    Rule("shelve_open", "deserialization", "critical", r"\bshelve\.open\s*\("),
    Rule("pickle_variants_load", "deserialization", "critical", r"\b(cPickle|cloudpickle|dill)\.(load|loads)\s*\(|\bjsonpickle\.(decode|encode)\s*\("),
    Rule("torch_unsafe_load", "deserialization", "critical", r"(?:\btorch\.load|\.torch_load)\s*\(", unless=r"torch\.load\s*\([^)]{0,200}weights_only\s*=\s*True"),
    Rule("yaml_unsafe_load_variants", "deserialization", "critical", r"(?:\byaml\.unsafe_load|\.yaml_unsafe_load)\s*\("),
    Rule("pickle_wrapper_load", "deserialization", "critical", r"\bjoblib\.load\s*\(|\b(?:pd|pandas)\.read_pickle\s*\(|\.cloudpickle_load\s*\(|\b(?:np|numpy)\.load\s*\([^)\n]{0,200}allow_pickle\s*=\s*True"),
    Rule("xml_unsafe_parse", "deserialization", "alert", r"\b(xml\.etree\.ElementTree|ElementTree|ET)\.(parse|fromstring|XML)\s*\(|\bminidom\.(parse|parseString)\s*\(|\bxml\.sax\.(parse|make_parser)\b"),
    Rule("node_createcipher_no_iv", "crypto", "alert", r"\bcrypto\.(createCipher|createDecipher)\b"),
    Rule("aes_ecb_mode", "crypto", "alert", r"\bAES\.MODE_ECB\b|\bmodes\.ECB\s*\(|['\x22]aes-\d+-ecb['\x22]"),
    Rule(
        "tls_verification_disabled", "crypto", "critical",
        r"\bverify\s*=\s*False\b|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\x22]?0|ssl\._create_unverified_context|check_hostname\s*=\s*False",
    ),
    Rule("weak_hash_md5", "crypto", "alert", r'\bmd5\b|MD5|\.md5\(|Crypto\.Hash\.MD5|hashlib\.md5|MessageDigest\.getInstance\("md5"\)|crypto\.createHash\("md5"\)|md5sum\s|MD5_Init\b'),
    Rule("weak_hash_sha1", "crypto", "alert", r"(?i)\bsha-?1\b|\.sha1\(|Crypto\.Hash\.SHA1|hashlib\.sha1|MessageDigest\.getInstance\(\s*['\x22]sha-?1['\x22]\s*\)|crypto\.createHash\(\s*['\x22]sha1['\x22]\s*\)|sha1sum\s"),
    Rule("weak_crypto_des", "crypto", "alert", r'\bDES\.MODE_|Cipher\.getInstance\("DES"\)|NewDESCipher|Cipher\.getInstance\("DESede"\)|\bDES3\b|\.DES_new_cipher\b'),
    Rule("java_objectinputstream_deserialization", "deserialization", "critical", r"\bObjectInputStream\b|\breadObject\s*\(|\breadUnshared\s*\("),
    Rule("java_runtime_exec_injection", "injection", "critical", r"\bRuntime\.getRuntime\(\)\.exec\s*\(|\bProcessBuilder\s*\(\s*[^)]*['\x22]"),
    Rule("csharp_process_start", "injection", "critical", r"\bProcess\.Start\s*\("),
    Rule("csharp_process_startinfo", "injection", "critical", r"new\s+ProcessStartInfo\s*\(|\.StartInfo\s*=\s*new\s+|\.StartInfo\.FileName\s*=|\.StartInfo\.Arguments\s*="),
    Rule("csharp_binary_formatter", "deserialization", "critical", r"\bBinaryFormatter\b|\.Deserialize\s*\(|NetDataContractSerializer|LosFormatter\b|SoapFormatter\b|ObjectStateFormatter\b"),
    Rule("csharp_xml_unsafe_parser", "xxe", "alert", r"\bXmlDocument\b|\bXmlTextReader\b|new\s+XmlReader\b"),
    Rule("csharp_sql_injection", "injection", "critical", r"\bSqlCommand\s*\(\s*['\x22].*\+|new\s+SqlCommand\s*\(\s*['\x22]"),
    Rule("python_sql_injection_fstring", "injection", "critical", r"\.execute\s*\(\s*f['\x22]", only=PY),
    Rule("python_sql_injection_concat", "injection", "critical", r"\.execute\s*\(\s*['\x22].*\+", only=PY),
    Rule("python_sql_injection_format", "injection", "critical", r"\.execute\s*\(\s*['\x22].*(?:%[srd]|\.format\s*\()", only=PY),
    Rule("javascript_sql_injection", "injection", "critical", r"\.(?:query|execute|prepare)\s*\(\s*(?:['\x22]|`)", only=JS),
    Rule("go_sql_injection", "injection", "critical", r"db\.(Query|Exec|QueryRow)\(\s*fmt\.Sprintf\(\s*['\x22]|\bdb\.(Query|Exec|QueryRow)\s*\(\s*['\x22].*\+", only=GO),
    Rule("java_sql_injection", "injection", "critical", r"Statement\.execute(?:Query|Update)?\s*\(\s*['\x22].*\+|createStatement\(\)\.execute|\.executeQuery\s*\(\s*['\x22].*\+"),
    Rule("php_sql_injection", "injection", "critical", r"\bmysql_query\s*\(\s*['\x22].*\$\w|mysqli_query\s*\(\s*[^,]+,\s*['\x22].*\$\w|\bpg_query\s*\(\s*[^,]+,\s*['\x22].*\$\w"),
    Rule("python_ssrf_requests", "injection", "alert", r"\brequests\.(get|post|put|delete|head|patch)\s*\(", only=PY),
    Rule("python_ssrf_urllib", "injection", "alert", r"\b(?:urllib\.request\.urlopen|urllib2\.urlopen|httpx\.get|aiohttp\.ClientSession)\s*\(", only=PY),
    Rule("javascript_ssrf_fetch", "injection", "alert", literals=("fetch(", "axios.get(", "axios.post("), only=JS),
    Rule("go_ssrf_http", "injection", "alert", r"\bhttp\.(Get|Post|Head|NewRequest)\s*\(", only=GO),
    Rule("python_path_traversal", "injection", "warning", r"\bos\.path\.join\s*\(", only=PY),
    Rule("javascript_path_traversal", "injection", "warning", r"\bpath\.(?:join|resolve)\s*\(", only=JS),
    Rule("go_path_traversal", "injection", "warning", r"\bfilepath\.Join\s*\(", only=GO),
)

#: Reported for its path alone, at the first line.
WORKFLOW = Rule("github_actions_workflow", "workflow", "warning")
WORKFLOW_PATH = r"\.github/workflows/.*\.ya?ml\z"

HASH_COMMENTS = (".rb", ".sh", ".bash", ".pl", ".yaml", ".yml", ".toml", ".tf", ".cfg", ".conf", ".ini", ".properties")
SLASH_COMMENTS = (
    ".go", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".java", ".rs", ".swift", ".kt", ".kts", ".cs", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".scala", ".php", ".sql"
)

# End of fixed values.
