"""Detector inputs derived from the given tables.

The tables hold prose, pages and orders, no model files. So names, opcodes,
headers, configurations and archives are derived from their rows: one SELECT
per input, over whole tables, in SQL that Spark and the checking engine read
alike (no backslash, no quote inside a literal). Text is inert: marker words only.
``@name`` stands for a table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Rows that one task should take at most.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table out evenly; a table whose splits hold about as many rows each stays as it is.

    The detectors are bound by computing, so tasks are measured in rows. Splits say
    little: they are cut by bytes, and a row group is read whole by one of them. The
    counts come from the footers; no column is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]
    rows, most = sum(held), max(held, default=0)
    even = len(held) >= cores and most <= max(TASK_ROWS, 2 * rows // len(held)) and most <= 4 * TASK_ROWS
    return df if even or not rows else df.repartition(max(cores, -(-rows // TASK_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a portable SELECT over the tables of a directory."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for name in sorted(set(re.findall(r"@(\w+)", sql))):
        table(spark, sf_dir, name).createOrReplaceTempView(f"tl_{tag}_{name}")
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"tl_{tag}_{m[1]}", sql))


def portable(sql: str) -> str:
    """The same SELECT for the checking engine."""
    return re.sub(r"@(\w+)", r"\1", sql)


def values(alias: str, columns: str, rows: list[tuple]) -> str:
    """An inline table; the first column numbers the rows from 0."""

    def cell(value) -> str:
        if isinstance(value, str):
            assert "'" not in value and "\\" not in value, value
            return f"'{value}'"
        return "NULL" if value is None else str(value)

    body = ", ".join(
        "(" + ", ".join([str(i), *[cell(v) for v in row]]) + ")" for i, row in enumerate(rows)
    )
    return f"(VALUES {body}) AS {alias}({columns})"


def le(expression: str, width: int) -> str:
    """Little-endian hex digits of a non-negative integer."""
    digits = f"lpad(hex(cast({expression} AS bigint)), 16, '0')"
    return "concat(" + ", ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(width)) + ")"


def le_hex(value: int, width: int = 8) -> str:
    return value.to_bytes(width, "little").hex().upper()


# --- texts -------------------------------------------------------------------

CORPUS = """
SELECT concat('doc/', cast(doc_id AS string)) AS path, concat('doc/', cast(doc_id AS string)) AS source, text
FROM @documents
UNION ALL
SELECT concat('page/', cast(page_id AS string)), concat('page/', cast(page_id AS string)), html FROM @pages
UNION ALL
SELECT concat('conv/', cast(conv_id AS string)),
       concat('conv/', cast(conv_id AS string), '/', cast(turn AS string)), text
FROM @conversations
"""

# Marker words, one or more per rule, and near misses. "~" is a backslash, "^" a single quote.
MARKERS = [
    "os.system (", "os.popen(", "os.execvp (", "os.spawnl(", "subprocess.run", "pty.spawn (",
    "commands.getoutput", "eval (", "exec (", "compile (", "__import__ (", "importlib.import_module",
    "__builtins__", "__globals__", "__subclasses__", "__mro__", "__code__", "__reduce__",
    "socket.socket", "requests.get", "urllib.request", "http.client", "ftplib.", "smtplib.",
    "open (name, ^w^)", "shutil.rmtree", "os.unlink", "os.chmod (", "pickle.loads", "_pickle.",
    "marshal.loads", "yaml.load", "jsonpickle.", "socket x connect y dup2", "os.dup2(s.fileno",
    "/bin/bash", "nc -e", "os.environ", "os.getenv (", "os.putenv (",
    "base64.b64decode", "codecs.decode(x, rot", "bytes.fromhex (", "bytearray.fromhex",
    "chr (1) + chr", "^^.join ([chr (", "~x41", "zlib.decompress", "gzip.GzipFile",
    "enable_unsafe_deserialization", "safe_mode = False", "^safe_mode^: False",
    "keras.config.enable_unsafe", "allow_pickle=True", "trust_remote_code = true",
    "get_file (", "169.254.169.254", "metadata.google.internal", "100.100.100.200", "file://x",
    "gopher://x", "dict://x", "ldap://x", "units: 12345678901", "shape = [ 99999999999", "2 ** 40",
    "^module^: ^os^", "^module^: ^subprocess^", "^module^: ^builtins^", "^class_name^: ^system^",
    "^function^: ^a __import__", "types.FunctionType", "types.CodeType", "marshal.dumps",
    "^bytecode^:", "^__code__^:", "co_code", "types.CodeType (", "types.FunctionType(",
    "LambdaCallback", "on_epoch_end^: ^import", "on_batch_begin^: ^os.", "on_train_end^: ^exec",
    "evaluate (x)", "medieval(", "open (name)", "oscar system", "module os", "nothing here",
    "OS.SYSTEM(", "2 ** 12", "units: 12", "file:/x", "safe_mode=True", "subprocess.other",
    "{{ x.__class__ }}", "{{ a }} __class__", "{% import x %}", "lipsum.__globals__", "../up", "..~up",
    "/etc/passwd", "%2E%2e%2F", "C:~Windows", "<script>", "javascript:x", "100%n", "50%d", "%5$x",
    "PyFunc", "ReadFile SaveV2", "CollectiveReduce", "Assert PrintV2", "pyfunc", "EagerPyFunc Timestamp",
]


def _word(column: str) -> str:
    return f"replace(replace({column}, '~', chr(92)), '^', chr(39))"


# One short text per order, around a marker chosen by its key.
MARKED = f"""
SELECT concat('order/', cast(o_orderkey AS string)) AS path, concat('order/', cast(o_orderkey AS string)) AS source,
       concat(o_orderpriority, ' ', {_word("m.word")}, ' ', o_orderstatus) AS text
FROM @orders JOIN {values("m", "n, word", [(w,) for w in MARKERS])} ON o_orderkey % {len(MARKERS)} = m.n
"""
TEXTS = f"{CORPUS} UNION ALL {MARKED}"

# Texts that mention URLs: pages with their address, and orders with up to three links.
_URLS = [
    "http://localhost:8080/a", "https://127.0.0.1/x", "http://10.1.2.3/y", "http://172.20.1.9/z",
    "http://172.40.1.9/z", "https://192.168.0.1/admin", "http://169.254.169.254/latest", "http://[::1]/x",
    "https://metadata.google.internal/v1", "file:///etc/hosts", "s3://bucket/key/one", "gs://bucket/obj",
    "ftp://files.example.org/pub", "https://huggingface.co/org/model", "https://cdn.example.net/w.bin",
    "https://sub.github.com/x", "https://notgithub.com/x", "HTTPS://Evil.Example.COM:8443/p?q=1",
    "http://a.b", "nothing", "https://pytorch.org.evil.example/x",
]
LINKED = f"""
SELECT concat('page/', cast(page_id AS string)) AS path, concat('page/', cast(page_id AS string)) AS source,
       concat(url, ' ', html) AS text
FROM @pages
UNION ALL
SELECT concat('order/', cast(o_orderkey AS string)), concat('order/', cast(o_orderkey AS string)),
       concat('see ', a.url, ' and <', b.url, '> or "', c.url, '" ', o_orderpriority)
FROM @orders
JOIN {values("a", "n, url", [(u,) for u in _URLS])} ON o_orderkey % {len(_URLS)} = a.n
JOIN {values("b", "n, url", [(u,) for u in _URLS])} ON o_custkey % {len(_URLS)} = b.n
JOIN {values("c", "n, url", [(u,) for u in _URLS])} ON (o_orderkey + o_custkey) % {len(_URLS)} = c.n
"""

# --- artifacts ---------------------------------------------------------------

_SUFFIXES = [
    ".pkl", ".pickle", ".pth", ".pt", ".bin", ".h5", ".hdf5", ".keras", ".pb", ".tflite", ".onnx", ".gguf",
    ".ggml", ".safetensors", ".npy", ".npz", ".joblib", ".model", ".whl", ".zip", ".tar", ".tar.gz",
    ".tar.bz2", ".tgz", ".txt", ".toml", ".jpg", ".png", ".gif", ".JPEG", "", ".cfg", ".exe",
]
_HEADS = [
    "934E554D5059", "800495", "8003", "8002", "504B0304", "1F8B08", "425A68", "894844460D0A1A0A",
    "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "47475546", "47474D4C", "424D",
    "52494646", "00000100", "25504446", "4D5A", "7F454C46", "23212F", "53514C69746520666F726D6174203300",
    "", "00", "0102030405060708", "CAFEBABE",
]
_TAILS = [
    "", "FFD9504B0304AAAAAAAAAAAAAAAA", "FFD9AAAAAAAAAAAAAAAAAAAAAAAA", "49454E44AE4260824D5A909090909090909090909090",
    "3B800495AAAAAAAAAAAAAAAAAAAA", "7F454C46", "2321002321", "47475546", "49454E4400000000", "FFD9",
]
# Model files by name, with a head, padding that pushes the rest past 64 bytes, and a tail.
ARTIFACTS = f"""
SELECT concat('models/c', cast(o_custkey AS string), '/m', cast(o_orderkey AS string), s.suffix) AS path,
       cast(o_orderkey AS bigint) AS key,
       unhex(concat(h.head, hex(o_orderpriority), repeat('20', cast(o_orderkey % 97 AS int)), t.tail)) AS content
FROM @orders
JOIN {values("s", "n, suffix", [(x,) for x in _SUFFIXES])} ON o_orderkey % {len(_SUFFIXES)} = s.n
JOIN {values("h", "n, head", [(x,) for x in _HEADS])} ON o_custkey % {len(_HEADS)} = h.n
JOIN {values("t", "n, tail", [(x,) for x in _TAILS])} ON (o_orderkey + o_custkey) % {len(_TAILS)} = t.n
"""

_NAMES = [
    "saved_model.pb", "config.json", "pytorch_model.bin", "model.safetensors", "notes.txt",
    "variables/variables.index", "weights.h5", "requirements.txt", "pyproject.toml", "setup.py", "README.md",
]
# Files in directories: one per line item, named by its part.
TREE = f"""
SELECT concat('hub/d', cast(l_suppkey AS string), '/v', cast(l_orderkey AS string), '/', f.name) AS path,
       cast(NULL AS string) AS entry
FROM @lineitem JOIN {values("f", "n, name", [(x,) for x in _NAMES])} ON l_partkey % {len(_NAMES)} = f.n
"""

# --- archives ----------------------------------------------------------------

_ENTRIES = [
    "data.pkl", "model/config.json", "../outside.txt", "a/../../b", "/etc/x", "C:/x", "weights/data/0",
    "constants.pkl", "version", "a/../b", "code/net.py", "model.json", "attributes.pkl", "..hidden", "./ok",
]
_ENTRY = (
    f"{values('e', 'n, entry', [(x,) for x in _ENTRIES])} ON l_partkey % {len(_ENTRIES)} = e.n"
)
_MODES = [(33188,), (41471,), (16877,), (0,)]
MEMBERS = f"""
SELECT concat('arch/', cast(l_orderkey AS string), '.zip') AS path, cast(l_linenumber AS int) AS ordinal,
       e.entry AS entry, 'central' AS origin, cast(m.mode AS int) AS unix_mode, m.mode = 41471 AS is_link,
       cast(NULL AS string) AS link_target
FROM @lineitem JOIN {_ENTRY} JOIN {values("m", "n, mode", _MODES)} ON l_suppkey % {len(_MODES)} = m.n
UNION ALL
SELECT concat('arch/', cast(l_orderkey AS string), '.zip'), cast(l_linenumber AS int),
       CASE WHEN l_quantity < 5 THEN concat(e.entry, '.bak') ELSE e.entry END, 'local', cast(NULL AS int), false,
       cast(NULL AS string)
FROM @lineitem JOIN {_ENTRY}
UNION ALL
SELECT concat('arch/', cast(l_suppkey AS string), '.tar'), cast(l_linenumber AS int),
       e.entry, 'tar', 420, l_returnflag = 'R',
       CASE WHEN l_returnflag <> 'R' THEN cast(NULL AS string) WHEN l_linenumber % 3 = 0 THEN '/etc/passwd'
            WHEN l_linenumber % 3 = 1 THEN '../up' ELSE 'inside.txt' END
FROM @lineitem JOIN {_ENTRY}
"""

# --- opcodes -----------------------------------------------------------------

_WORDS = [
    "os", "system", "subprocess", "Popen", "numpy", "array", "collections", "OrderedDict", "builtins", "eval",
    "torch", "base64", "requests", "get", "posix", "sys", "exit",
]
_PAIRS = [
    "os system", "numpy core", "builtins exec", "__builtin__ compile", "collections OrderedDict", "sys exit",
    "requests get", "pickle loads", "torch nn", "socket socket", "threading Thread",
]
# An opcode per event; the user is the pickle it belongs to.
OPCODES = f"""
SELECT concat('u', cast(user_id AS string)) AS source, cast(event_id AS bigint) AS seq, cast(event_id AS bigint) AS pos,
       CASE event_id % 10 WHEN 0 THEN 'SHORT_BINUNICODE' WHEN 1 THEN 'BINUNICODE' WHEN 2 THEN 'SHORT_BINUNICODE'
            WHEN 3 THEN 'MEMOIZE' WHEN 4 THEN 'BINGET' WHEN 5 THEN 'STACK_GLOBAL' WHEN 6 THEN 'STACK_GLOBAL'
            WHEN 7 THEN 'REDUCE' WHEN 8 THEN 'GLOBAL'
            ELSE CASE event_type WHEN 'click' THEN 'BUILD' WHEN 'view' THEN 'BINPUT' ELSE 'POP' END END AS opcode,
       CASE WHEN event_id % 10 IN (0, 1, 2) THEN w.word WHEN event_id % 10 = 4 THEN cast(event_id % 7 AS string)
            WHEN event_id % 10 = 8 THEN p.pair
            WHEN event_id % 10 = 9 AND event_type = 'view' THEN cast(event_id % 3 AS string) END AS arg
FROM @events
JOIN {values("w", "n, word", [(x,) for x in _WORDS])} ON event_id % {len(_WORDS)} = w.n
JOIN {values("p", "n, pair", [(x,) for x in _PAIRS])} ON event_id % {len(_PAIRS)} = p.n
"""

# An inert pickle per event: it names an import, drops it and returns None.
PICKLES = f"""
SELECT concat('p/', cast(event_id AS string)) AS source, p.module AS module, p.name AS name,
       unhex(concat('8002', '63', hex(p.module), '0A', hex(p.name), '0A', '30', '4E', '2E')) AS content
FROM @events
JOIN {values("p", "n, module, name", [tuple(x.split(" ")) for x in _PAIRS])} ON event_id % {len(_PAIRS)} = p.n
"""

# --- GGUF --------------------------------------------------------------------

_VERSIONS = [1, 2, 3, 0, 4, 1000, 1001, 0xDEADBEEF, 0x41414141, 0x80000001, 0xFFFFFFFF]
_COUNTS = [
    10, 100000, 100001, (2**63 - 1) // 88, (2**63 - 1) // 88 + 1, 2**64 - 1, 0x1D1D1D1D1D1D1D1D, 2**63 + 5, 500,
    0x7FFFFFFF, 0,
]
_COUNT_ROWS = [(str(n), le_hex(n)) for n in _COUNTS]
HEADERS = f"""
SELECT concat('g/', cast(l_orderkey AS string), '/', cast(l_linenumber AS string), '.gguf') AS path,
       cast(l_partkey + 24 AS bigint) AS length, cast(v.version AS bigint) AS version, t.n AS tensors, k.n AS entries,
       unhex(concat('47475546', {le("v.version", 4)}, t.bytes, k.bytes)) AS content
FROM @lineitem
JOIN {values("v", "i, version", [(v,) for v in _VERSIONS])} ON (l_orderkey + l_linenumber) % {len(_VERSIONS)} = v.i
JOIN {values("t", "i, n, bytes", _COUNT_ROWS)} ON l_partkey % {len(_COUNTS)} = t.i
JOIN {values("k", "i, n, bytes", _COUNT_ROWS)} ON l_suppkey % {len(_COUNTS)} = k.i
"""

_LENGTHS = [5, 12, 2**31, 2**31 + 1, 0xDEADBEEF, 10 * 1024 * 1024, 10 * 1024 * 1024 + 1, 2**64 - 1, 33, 7, 64, 20]
# Mostly harmless lengths: 29 of 41.
_NAME_LENGTHS = [*range(4, 33), *_LENGTHS]
# Directory rows with field values on both sides of every limit.
KV_ROWS = f"""
SELECT concat('g/', cast(floor(o_orderkey / 5) AS bigint)) AS path, cast(o_orderkey % 5 AS int) AS idx,
       cast(o_custkey AS bigint) AS offset, cast(a.n AS decimal(20,0)) AS key_len,
       cast((o_custkey + o_orderkey) % 14 AS bigint) AS value_type, cast(b.n AS decimal(20,0)) AS str_len,
       cast(CASE WHEN o_custkey % 10 < 5 THEN c.n WHEN o_custkey % 10 < 7 THEN '10000001' ELSE '9' END AS decimal(20,0)) AS arr_len,
       o_custkey % 50 = 3 AS truncated
FROM @orders
JOIN {values("a", "i, n", [(str(n),) for n in _NAME_LENGTHS])} ON o_custkey % 41 = a.i
JOIN {values("b", "i, n", [(str(n),) for n in _LENGTHS])} ON floor(o_custkey / 7) % 12 = b.i
JOIN {values("c", "i, n", [(str(n),) for n in _LENGTHS])} ON o_orderkey % 12 = c.i
"""

_DIMS = [1, 2, 4096, 0, 2**40, 2**62, 2**63, 0xCAFEBABE, 32000, 7]
TENSOR_ROWS = f"""
SELECT concat('g/', cast(floor(o_orderkey / 5) AS bigint)) AS path, cast(o_orderkey % 5 AS int) AS idx,
       cast(o_custkey AS bigint) AS offset, cast(a.n AS decimal(20,0)) AS name_len,
       cast(CASE WHEN o_custkey % 30 = 0 THEN 5 ELSE 2 END AS bigint) AS n_dims,
       cast(b.n AS decimal(20,0)) AS dim0, cast(CASE WHEN o_custkey % 4 > 0 THEN '3' ELSE c.n END AS decimal(20,0)) AS dim1
FROM @orders
JOIN {values("a", "i, n", [(str(n),) for n in _NAME_LENGTHS])} ON o_custkey % 41 = a.i
JOIN {values("b", "i, n", [(str(n),) for n in _DIMS])} ON floor(o_custkey / 3) % 10 = b.i
JOIN {values("c", "i, n", [(str(n),) for n in _DIMS])} ON o_orderkey % 10 = c.i
"""

# Tensor sizes whose sum passes the signed 64-bit limit within a file.
SIZES = """
SELECT concat('s', cast(o_custkey % 40 AS string)) AS path, cast(o_orderkey AS bigint) AS idx,
       cast(floor(o_totalprice) AS bigint) * 1000000000000 AS size
FROM @orders
"""

# --- weights -----------------------------------------------------------------

# Embeddings by label, and columns that repeat, climb evenly, never change or scatter.
WEIGHTS_TAIL = """
SELECT 'parts' AS path, concat('sizes', cast(p_size % 2 AS string)) AS layer, cast(p_partkey AS bigint) AS pos,
       cast(p_size AS double) AS value FROM @part
UNION ALL SELECT 'orders', concat('keys', o_orderstatus), cast(o_orderkey AS bigint), cast(o_orderkey AS double) FROM @orders
UNION ALL SELECT 'orders', 'steps', cast(o_orderkey AS bigint), cast(o_orderkey AS double) / 1000 FROM @orders
UNION ALL SELECT 'orders', concat('flat', o_orderpriority), cast(o_orderkey AS bigint), cast(1 AS double) FROM @orders
UNION ALL SELECT concat('totals', o_orderstatus), concat('price', cast(o_custkey % 3 AS string)), cast(o_orderkey AS bigint),
       CASE WHEN o_orderkey % 61 = 0 THEN o_totalprice * 50 ELSE cast(o_custkey % 100 AS double) END FROM @orders
"""

# --- dependencies ------------------------------------------------------------

_PACKAGES = [
    "numpy", "pandas", "scikit-learn", "tensorflow", "torch", "requests", "pyyaml", "google-cloud-storage",
    "transformers", "boto3", "matplotlib", "left-pad", "mylib", "tool-python", "python-thing", "a.b",
]
_EDITED = """CASE o_custkey % 9 WHEN 0 THEN p.name WHEN 1 THEN substr(p.name, 2) WHEN 2 THEN concat(p.name, 's')
 WHEN 3 THEN concat(substr(p.name, 1, 2), 'q', substr(p.name, 4)) WHEN 4 THEN concat(p.name, '-utils')
 WHEN 5 THEN concat('python-', p.name) WHEN 6 THEN upper(p.name)
 WHEN 7 THEN concat(substr(p.name, 1, 2), substr(p.name, 4, 1), substr(p.name, 3, 1), substr(p.name, 5))
 ELSE replace(p.name, '-', '_') END"""
_PACKAGE = f"{values('p', 'n, name', [(x,) for x in _PACKAGES])} ON o_orderkey % {len(_PACKAGES)} = p.n"
_EXTRA = [
    "# comment", "--index-url https://mirror.example/simple", "-r other.txt", "git+https://github.com/x/y",
    "https://pastebin.com/raw/x.whl", "  ", "--extra-index-url https://x.github.io",
    "http://host.example/z.tar.gz ; python_version > 3", "pkg[extra]>=1.0 ; os_name",
]
_EXTRA_LINE = f"{values('x', 'n, line', [(x,) for x in _EXTRA])} ON (o_orderkey + o_custkey) % {len(_EXTRA)} = x.n"
REQUIREMENTS = f"""
SELECT concat('r/', cast(o_orderkey AS string), '/requirements.txt') AS path,
       concat('r/', cast(o_orderkey AS string), '/requirements.txt') AS source,
       concat(o_orderpriority, chr(10), {_EDITED}, '==1.', cast(o_custkey AS string), chr(10), x.line) AS text
FROM @orders JOIN {_PACKAGE} JOIN {_EXTRA_LINE}
UNION ALL
SELECT concat('doc/', cast(doc_id AS string)), concat('doc/', cast(doc_id AS string)), text FROM @documents
"""
PYPROJECT = f"""
SELECT concat('r/', cast(o_orderkey AS string), '/pyproject.toml') AS path,
       concat('r/', cast(o_orderkey AS string), '/pyproject.toml') AS source,
       concat('[project]', chr(10), 'name = "', o_orderpriority, '"', chr(10), 'dependencies = [', chr(10),
              '  "', {_EDITED}, '>=1.2",', chr(10), '  "', x.line, '",', chr(10), ']', chr(10), 'other = "numpy"', chr(10),
              'Dev-Dependencies = [', chr(10), '  "pytest"', chr(10), ']') AS text
FROM @orders JOIN {_PACKAGE} JOIN {_EXTRA_LINE}
"""
SETUP_PY = f"""
SELECT concat('r/', cast(o_orderkey AS string), '/setup.py') AS path,
       concat('r/', cast(o_orderkey AS string), '/setup.py') AS source,
       concat('setup(name="', o_orderstatus, '", ', CASE WHEN o_custkey % 4 = 0 THEN 'requires' ELSE 'install_requires' END,
              '=[', chr(10), '"', {_EDITED}, '>=1", ', chr(39), 'six', chr(39), ', "', x.line, '"],', chr(10), 'extra=["no"])') AS text
FROM @orders JOIN {_PACKAGE} JOIN {_EXTRA_LINE}
"""
WHEEL = f"""
SELECT concat('w/', cast(o_orderkey AS string), '.whl') AS path, concat('w/', cast(o_orderkey AS string), '.whl') AS source,
       concat('Name: ', o_orderpriority, chr(10), 'Requires-Dist: ', {_EDITED}, ' (>=1)', chr(10),
              'Requires-Dist:  ', x.line, chr(10), 'Summary: Requires-Dist: no') AS text
FROM @orders JOIN {_PACKAGE} JOIN {_EXTRA_LINE}
"""

# --- JSON --------------------------------------------------------------------

_CLASSES = [
    "Lambda", "Dense", "Custom", "CustomObject", "enable_unsafe_deserialization", "Conv2D", "lambda", "Dense",
]
_MODULES = ["keras.layers", "os", "subprocess", "my_custom.mod", "builtins", "os.path", "sys", "keras"]
_BODIES = [
    '"ZXZhbCgieCIp"', '"os.system(x)"', '"not base64!"', '{"function_name": "f", "module": "os"}',
    '{"code": "exec(1)"}', '{"bytecode": "AAAA"}', '""', '{"other": 1}',
]
_UNITS = ["10", "1000000000", "1000000001", "99999999999999999999", "2.5e10", '"5000000000"']
_LINKS = ["http://169.254.169.254/x", "https://ok.example/w", "http://LOCALHOST/x", "gopher://h", ""]
_FIELDS = ["plain", "50%n", "%5$x", "<script>x", "JavaScript:go", "100%", "eval (x)", "é<b>", "data:text/html,x"]
CONFIGS = f"""
SELECT concat('k/', cast(o_orderkey AS string), '.keras') AS path,
       concat('k/', cast(o_orderkey AS string), '.keras:config.json') AS source,
       CASE WHEN o_orderkey % 50 = 49 THEN 'not json' ELSE concat(
         '{{"class_name": "Functional", "note": "', f.v, '", "skip": {{"class_name": "Lambda"}}, "config": {{"units": 3, "layers": [',
         '{{"class_name": "', c.v, '", "module": "', m.v, '", "config": {{"units": ', u.v, ', "function": ', b.v, '}}, "weights_url": "', l.v, '"}}, ',
         '[{{"class_name": "Dense", "inner_model": {{"class_name": "', c.v, '", "config": {{"module": "sys"}}}}}}], "text"]}}, ',
         '"origin": "', l.v, '", "loader": "', CASE WHEN o_custkey % 2 = 0 THEN 'get_file' ELSE 'none' END, '", ',
         '"callbacks": [{{"class_name": "LambdaCallback"}}, {{"class_name": "Other"}}, {{"class_name": "',
         CASE WHEN o_custkey % 3 = 0 THEN 'LambdaCallback' ELSE 'EarlyStopping' END, '"}}]}}') END AS text,
       c.v AS c, m.v AS m, b.v AS b, u.v AS u, l.v AS l, f.v AS f, o_custkey AS custkey
FROM @orders
JOIN {values("c", "n, v", [(x,) for x in _CLASSES])} ON o_orderkey % {len(_CLASSES)} = c.n
JOIN {values("m", "n, v", [(x,) for x in _MODULES])} ON o_custkey % {len(_MODULES)} = m.n
JOIN {values("b", "n, v", [(x,) for x in _BODIES])} ON (o_orderkey + o_custkey) % {len(_BODIES)} = b.n
JOIN {values("u", "n, v", [(x,) for x in _UNITS])} ON o_orderkey % {len(_UNITS)} = u.n
JOIN {values("l", "n, v", [(x,) for x in _LINKS])} ON o_custkey % {len(_LINKS)} = l.n
JOIN {values("f", "n, v", [(x,) for x in _FIELDS])} ON o_orderkey % {len(_FIELDS)} = f.n
"""

_WORDS_MS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "OTHER"]
_MODULES_MS = ["os", "posix", "socket", "shutil", "Keras", "numpy", "builtins"]
MODELSCAN = f"""
SELECT concat('ms/', cast(o_orderkey AS string)) AS path, w.v AS word, m.v AS module, o_custkey AS custkey,
       concat('{{"modelscan_version": "x", "issues_by_severity": {{"', w.v, '": [{{"module": "', m.v, '", "operator": "f"',
              CASE WHEN o_custkey % 2 = 0 THEN ', "description": "told"' ELSE '' END,
              '}}], "LOW2": [{{"operator": "g"}}]}}}}') AS text
FROM @orders
JOIN {values("w", "n, v", [(x,) for x in _WORDS_MS])} ON o_orderkey % {len(_WORDS_MS)} = w.n
JOIN {values("m", "n, v", [(x,) for x in _MODULES_MS])} ON o_custkey % {len(_MODULES_MS)} = m.n
"""
_RULES_GD = [
    "code-execution", "typosquatting", "obfuscation", "shady-links", "bundled_binary", "release_zero", "new-rule",
    "exfiltrate-sensitive-data", "clipboard-access",
]
GUARDDOG = f"""
SELECT concat('gd/', cast(o_orderkey AS string)) AS path, r.v AS rule, o_custkey AS custkey,
       concat(CASE WHEN o_custkey % 2 = 0 THEN '[' ELSE '' END,
              '{{"package": "p", "errors": ["e', o_orderstatus, '"], "results": {{"', r.v, '": ',
              CASE WHEN o_custkey % 3 = 0 THEN '[]' WHEN o_custkey % 3 = 1 THEN '["x"]' ELSE '{{"a": 1}}' END,
              '}}, "issues": [{{"code": "', r.v, '", "message": "m"}}, {{"rule": "empty_information"}}]}}',
              CASE WHEN o_custkey % 2 = 0 THEN ']' ELSE '' END) AS text
FROM @orders JOIN {values("r", "n, v", [(x,) for x in _RULES_GD])} ON o_orderkey % {len(_RULES_GD)} = r.n
"""

# --- CVSS --------------------------------------------------------------------

VECTORS = """
SELECT concat(CASE WHEN l_linenumber % 2 = 0 THEN 'CVSS:3.0/' ELSE 'CVSS:3.1/' END,
              'AV:', substr('NALPX', cast(l_orderkey % 5 AS int) + 1, 1), '/AC:', substr('LH', cast(l_partkey % 2 AS int) + 1, 1),
              CASE WHEN l_quantity < 10 THEN '' ELSE concat('/PR:', substr('NLH', cast(l_suppkey % 3 AS int) + 1, 1)) END,
              '/UI:', substr('NR', cast(l_linenumber % 2 AS int) + 1, 1), '/S:', substr('UC', cast(l_orderkey % 2 AS int) + 1, 1),
              '/C:', substr('NLH', cast(l_partkey % 3 AS int) + 1, 1), '/I:', substr('NLH', cast(l_suppkey % 3 AS int) + 1, 1),
              '/A:', substr('NLH', cast((l_orderkey + l_linenumber) % 3 AS int) + 1, 1)) AS cvss_vector,
       substr('NALPX', cast(l_orderkey % 5 AS int) + 1, 1) AS av, substr('LH', cast(l_partkey % 2 AS int) + 1, 1) AS ac,
       CASE WHEN l_quantity < 10 THEN 'N' ELSE substr('NLH', cast(l_suppkey % 3 AS int) + 1, 1) END AS pr,
       substr('NR', cast(l_linenumber % 2 AS int) + 1, 1) AS ui, substr('UC', cast(l_orderkey % 2 AS int) + 1, 1) AS sc,
       substr('NLH', cast(l_partkey % 3 AS int) + 1, 1) AS ci, substr('NLH', cast(l_suppkey % 3 AS int) + 1, 1) AS ii,
       substr('NLH', cast((l_orderkey + l_linenumber) % 3 AS int) + 1, 1) AS ai
FROM @lineitem
"""


# --- archives and directories as bytes ----------------------------------------


def _joined(hexes, order: str) -> object:
    """Hex pieces of a group in order; a file has at most five lines."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, hexes.alias("h")))), lambda s: s["h"]), "")


# Five consecutive orders make a file, so that no file has more than five lines.
LINES = f"""
SELECT cast(floor(o_orderkey / 5) AS bigint) AS file, cast(o_orderkey % 5 + 1 AS int) AS line, cast(o_custkey AS bigint) AS partkey,
       cast(o_custkey % 100 AS bigint) AS suppkey, concat(cast(o_orderkey % 5 AS string), '/', e.entry) AS entry,
       cast(m.mode AS bigint) AS mode, cast(floor(o_totalprice) AS bigint) AS quantity, b.bits AS bits, cast(b.v AS double) AS value
FROM @orders JOIN {values("e", "n, entry", [(x,) for x in _ENTRIES])} ON o_custkey % {len(_ENTRIES)} = e.n
JOIN {values("m", "n, mode", _MODES)} ON o_orderkey % {len(_MODES)} = m.n
JOIN {values("b", "n, bits, v", [("0000803F", 1.0), ("00000040", 2.0), ("000080BF", -1.0), ("0000003F", 0.5), ("00000000", 0.0)])} ON floor(o_custkey / 2) % 5 = b.n
"""


def zip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a stored zip per file, one member per line, its weight bits inside."""
    lines = derive(spark, sf_dir, LINES)
    name, data = "hex(entry)", "bits"
    common = (
        "'0000', '0000', '0000', '0000', "
        + f"{le('crc32(unhex(bits))', 4)}, '04000000', '04000000', {le('length(entry)', 2)}, '0000'"
    )
    local = F.expr(f"concat('504B0304', '1400', {common}, {name}, {data})")
    attributes = le("mode * 65536", 4)
    central = F.expr(
        f"concat('504B0102', '1403', '1400', {common}, '0000', '0000', '0000', {attributes}, "
        f"{le('at', 4)}, {name})"
    )
    # Where each local record starts: what the earlier lines of the file take up.
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn(
        "at", F.coalesce(F.sum(F.lit(34) + F.length("entry")).over(before), F.lit(0))
    )
    parts = placed.groupBy("file").agg(
        _joined(local, "line").alias("locals"), _joined(central, "line").alias("centrals"), F.count(F.lit(1)).alias("n")
    )
    end = F.expr(
        f"concat('504B0506', '00000000', {le('n', 2)}, {le('n', 2)}, {le('length(centrals) div 2', 4)}, "
        f"{le('length(locals) div 2', 4)}, '0000')"
    )
    return parts.select(
        F.concat(F.lit("z/"), F.col("file").cast("string"), F.lit(".zip")).alias("path"),
        F.unhex(F.concat("locals", "centrals", end)).alias("content"),
    )


def gguf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content): a GGUF per file, an entry and a tensor per line."""
    lines = derive(spark, sf_dir, LINES)
    key = "concat('k', cast(partkey AS string))"
    text = "concat('v', cast(suppkey AS string))"
    entry = F.expr(
        f"""concat({le(f'length({key})', 8)}, hex({key}), CASE suppkey % 4
            WHEN 0 THEN concat('04000000', {le('partkey', 4)})
            WHEN 1 THEN concat('08000000', {le(f'length({text})', 8)}, hex({text}))
            WHEN 2 THEN concat('09000000', '00000000', {le('line', 8)}, repeat('00', line))
            ELSE concat('0A000000', {le('partkey', 8)}) END)"""
    )
    name = "concat('t', cast(line AS string))"
    tensor = F.expr(
        f"concat({le(f'length({name})', 8)}, hex({name}), '02000000', {le('quantity', 8)}, {le('partkey', 8)}, repeat('00', 12))"
    )
    head = F.expr(f"concat('47475546', '03000000', {le('n', 8)}, {le('n', 8)})")
    files = (
        lines.groupBy("file")
        .agg(_joined(entry, "line").alias("entries"), _joined(tensor, "line").alias("tensors"), F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("g/"), F.col("file").cast("string"), F.lit(".gguf")).alias("path"),
            F.unhex(F.concat(head, "entries", "tensors")).alias("content"),
        )
    )
    return files.withColumn("length", F.octet_length("content").cast("bigint"))


def safetensors_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content): a tensor of 32-bit floats per file, a value per line."""
    lines = derive(spark, sf_dir, LINES)
    bits = lines.groupBy("file").agg(_joined(F.col("bits"), "line").alias("data"), F.count(F.lit(1)).alias("n"))
    header = F.concat(
        F.lit('{"__metadata__":{"format":"pt"},"w":{"dtype":"F32","shape":['), F.col("n").cast("string"),
        F.lit('],"data_offsets":[0,'), (F.col("n") * 4).cast("string"), F.lit("]}}"),
    )
    return (
        bits.withColumn("header", header)
        .select(
            F.concat(F.lit("s/"), F.col("file").cast("string"), F.lit(".safetensors")).alias("path"),
            F.unhex(F.concat(F.expr(le("length(header)", 8)), F.hex(F.encode("header", "UTF-8")), "data")).alias("content"),
        )
        .withColumn("length", F.octet_length("content").cast("bigint"))
    )


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("emb"), (F.col("label") % 3).cast("string")).alias("path"),
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("layer"),
        "vec_id",
        F.posexplode("embedding").alias("i", "x"),
    )
    return vectors.select(
        "path", "layer", (F.col("vec_id") * 64 + F.col("i")).alias("pos"), F.col("x").cast("double").alias("value")
    ).unionByName(derive(spark, sf_dir, WEIGHTS_TAIL))


WEIGHTS_SQL = f"""
SELECT path, layer, vec_id * 64 + i AS pos, cast(embedding[i + 1] AS double) AS value
FROM (SELECT concat('emb', cast(label % 3 AS string)) AS path, concat('label', cast(label AS string)) AS layer,
             vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)
UNION ALL {portable(WEIGHTS_TAIL)}
"""
