"""Names of modules and packages that need no declaration: the reference's catalogs, whole (src/data/*.ts)."""

PYTHON_STDLIB = frozenset(
    """
    __future__ os sys re json csv math random datetime time collections itertools functools operator pathlib shutil subprocess threading
    multiprocessing logging argparse unittest typing dataclasses abc io hashlib hmac secrets base64 struct pickle copy pprint textwrap string enum
    contextlib traceback warnings weakref types inspect dis gc site codecs unicodedata locale gettext calendar heapq bisect array queue socket http
    urllib xml html email ftplib smtplib telnetlib ssl select selectors asyncio concurrent xmlrpc ipaddress uuid platform ctypes signal mmap tempfile
    glob fnmatch linecache stat fileinput configparser toml zipfile tarfile gzip bz2 lzma zlib sqlite3 dbm token tokenize ast symtable compileall pdb
    profile timeit trace resource http.server http.client http.cookies http.cookiejar urllib.request urllib.parse urllib.error urllib.robotparser
    xml.etree.ElementTree xml.dom xml.sax xml.parsers html.parser html.entities socketserver webbrowser xmlrpc.client xmlrpc.server poplib imaplib
    nntplib asyncio.subprocess asyncio.streams plistlib email.mime email.mime.text email.mime.base email.mime.multipart email.header email.utils
    email.message mailcap mailbox mimetypes netrc xdrlib curses curses.textpad dbm.dumb dbm.gnu dbm.ndbm os.path atexit syslog posix nt pwd spwd grp
    nis unittest.mock unittest.runner unittest.suite unittest.case doctest pydoc py_compile bdb cProfile pstats faulthandler tracemalloc encodings
    collections.abc collections.defaultdict collections.OrderedDict collections.Counter collections.deque collections.namedtuple collections.ChainMap
    numbers decimal fractions statistics cmath sched weakref.WeakKeyDictionary weakref.WeakValueDictionary types.MappingProxyType
    types.SimpleNamespace functools.lru_cache functools.partial functools.wraps itertools.chain itertools.combinations operator.attrgetter
    operator.itemgetter copy.deepcopy difflib contextvars threading.Thread threading.Lock threading.Event threading.Condition threading.Semaphore
    threading.Barrier multiprocessing.Pool multiprocessing.Queue concurrent.futures concurrent.futures.ThreadPoolExecutor
    concurrent.futures.ProcessPoolExecutor queue.Queue queue.LifoQueue queue.PriorityQueue subprocess.run subprocess.Popen asyncio.run asyncio.gather
    asyncio.create_task zoneinfo venv zipapp importlib importlib.metadata importlib.resources pkgutil modulefinder runpy sysconfig code codeop crypt
    curses.ascii turtle tkinter colorsys imghdr sndhdr wave chunk aifc sunau audioop msvcrt winreg winsound posixpath ntpath genericpath optparse
    getpass cmd shlex tty pty termios readline rlcompleter
    """.split()
)

PYTHON_COMMON_PACKAGES = frozenset(
    """
    flask django fastapi tornado bottle aiohttp sanic starlette requests httpx urllib3 numpy pandas scipy sklearn scikit_learn matplotlib seaborn
    plotly bokeh statsmodels sympy torch tensorflow keras transformers openai anthropic langchain tiktoken huggingface_hub diffusers accelerate docx
    python_docx openpyxl xlrd xlwt pdfplumber pypdf reportlab fpdf weasyprint markdown beautifulsoup4 bs4 lxml html5lib dotenv python_dotenv pydantic
    hydra click typer rich toml pyyaml yaml configparser sqlalchemy psycopg2 pymysql mysql redis mongo pymongo alembic peewee tortoise bcrypt passlib
    jose pyjwt jwt cryptography paramiko oauthlib authlib pytest mock unittest nose coverage tox hypothesis celery dramatiq rq pillow PIL opencv cv2
    imageio wand easyocr pytesseract argcomplete colorama tqdm marshmallow cattrs attrs dataclasses_json sentry_sdk structlog loguru dateutil pytz
    arrow pendulum croniter jinja2 mako cherrypy fabric ansible boto3 botocore psutil watchdog schedule tenacity retry deprecation cachetools
    functools_cache more_itertools toolz inflect inflection python_dateutil six future setuptools pip wheel uvicorn gunicorn werkzeug
    """.split()
)

NODE_BUILTINS = frozenset(
    """
    assert assert/strict async_hooks buffer child_process cluster console crypto dgram diagnostics_channel dns dns/promises domain events fs
    fs/promises http http2 https inspector module net os path perf_hooks process punycode querystring readline readline/promises repl stream
    stream/consumers stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi
    worker_threads zlib node:assert node:assert/strict node:async_hooks node:buffer node:child_process node:cluster node:console node:crypto
    node:dgram node:diagnostics_channel node:dns node:dns/promises node:domain node:events node:fs node:fs/promises node:http node:http2 node:https
    node:inspector node:module node:net node:os node:path node:perf_hooks node:process node:punycode node:querystring node:readline
    node:readline/promises node:repl node:stream node:stream/consumers node:stream/promises node:stream/web node:string_decoder node:sys node:timers
    node:timers/promises node:tls node:trace_events node:tty node:url node:util node:util/types node:v8 node:vm node:wasi node:worker_threads
    node:zlib node:test test node:sqlite sqlite
    """.split()
)

RUBY_STDLIB = frozenset(
    """
    csv digest drb erb fileutils find forwardable io/console ipaddr json logger monitor net/http net/https net/ftp net/smtp net/pop net/imap
    net/telnet objspace open3 open-uri optparse ostruct pathname pp prettyprint prime pstore psych racc rake rdoc resolv rexml rss rubygems
    securerandom set shellwords singleton socket stringio strscan syslog tempfile thread timeout tmpdir tracer tsort uri weakref yaml zlib bigdecimal
    cgi cmath coverage date dbm delegate did_you_mean digest/md5 digest/sha1 digest/sha2 etc fcntl fiddle gdbm getoptlong io/nonblock io/wait irb
    kconv nkf observer openssl optionparser pty readline rexml/document ripper sdbm syslog/logger time un unicode_normalize win32ole
    """.split()
)

# Standard packages of other languages. Of those whose names nest (NESTED), what lies below an entry counts too.
GO_STDLIB = set(
    """archive archive/tar archive/zip bufio builtin bytes compress compress/bzip2 compress/flate compress/gzip compress/lzw compress/zlib container container/heap container/list container/ring context crypto
    crypto/aes crypto/cipher crypto/des crypto/dsa crypto/ecdsa crypto/ed25519 crypto/elliptic crypto/hmac crypto/md5 crypto/rand crypto/rc4 crypto/rsa crypto/sha1 crypto/sha256 crypto/sha512 crypto/subtle
    crypto/tls crypto/x509 database database/sql debug debug/dwarf debug/elf debug/gosym debug/macho debug/pe debug/plan9obj embed encoding encoding/ascii85 encoding/asn1 encoding/base32 encoding/base64
    encoding/binary encoding/csv encoding/gob encoding/hex encoding/json encoding/pem encoding/xml errors expvar flag fmt go go/ast go/build go/constant go/doc go/format go/importer go/parser go/printer
    go/scanner go/token go/types hash hash/adler32 hash/crc32 hash/crc64 hash/fnv html html/template image image/color image/color/palette image/draw image/gif image/jpeg image/png index index/suffixarray
    io io/fs io/ioutil log log/syslog maps math math/big math/bits math/cmplx math/rand mime mime/multipart mime/quotedprintable net net/http net/http/cgi net/http/cookiejar net/http/fcgi net/http/httptest
    net/http/httptrace net/http/httputil net/http/pprof net/mail net/netip net/rpc net/rpc/jsonrpc net/smtp net/textproto net/url os os/exec os/signal os/user path path/filepath plugin reflect regexp
    regexp/syntax runtime runtime/cgo runtime/debug runtime/metrics runtime/pprof runtime/race runtime/trace slices sort strconv strings sync sync/atomic syscall testing testing/fstest testing/iotest
    testing/quick text text/scanner text/tabwriter text/template text/template/parse time unicode unicode/utf16 unicode/utf8 unsafe""".split()
)
JAVA_STDLIB = set(
    """java.lang java.util java.io java.net java.nio java.math java.time java.text java.security java.awt java.applet java.beans java.rmi java.sql javax.crypto javax.net.ssl javax.security.auth javax.sql
    javax.xml.parsers javax.xml.transform javax.xml.bind javax.json javax.swing javax.awt javax.naming javax.management org.w3c.dom org.xml.sax""".split()
)
RUST_STDLIB = set("std core alloc proc_macro test crate self super".split())
PHP_STDLIB = set(
    """Core standard SPL Reflection curl date dom fileinfo filter hash iconv json libxml mbstring mysqlnd openssl pcre PDO pdo_mysql pdo_pgsql pdo_sqlite pgsql Phar posix random readline redis session SimpleXML
    soap sockets sodium sqlite3 tokenizer xml xmlreader xmlwriter xsl zip zlib ArrayAccess ArrayObject Closure Countable DirectoryIterator DomainException ErrorException Exception FilesystemIterator
    FilterIterator GlobIterator InvalidArgumentException Iterator IteratorAggregate LengthException LogicException OutOfBoundsException OutOfRangeException OverflowException PDOException RangeException
    RecursiveArrayIterator RecursiveDirectoryIterator RecursiveIteratorIterator RuntimeException SeekableIterator Serializable SplFixedArray SplHeap SplMaxHeap SplMinHeap SplObjectStorage SplPriorityQueue
    SplQueue SplStack Traversable UnderflowException UnexpectedValueException""".split()
)
C_HEADERS = {f"{n}.h" for n in "stdio stdlib string math time ctype errno signal assert stddef stdbool stdint inttypes limits float locale setjmp stdarg complex fenv tgmath wchar wctype iso646".split()}
CPP_HEADERS = C_HEADERS | set(
    """algorithm array atomic bitset chrono codecvt compare complex concepts condition_variable coroutine deque exception execution filesystem format forward_list fstream functional future initializer_list
    iomanip ios iosfwd iostream istream iterator limits list locale map memory memory_resource mutex new numbers numeric optional ostream queue random ranges ratio regex scoped_allocator set shared_mutex
    source_location span sstream stack stdexcept stop_token streambuf string string_view strstream syncstream system_error thread tuple type_traits typeindex typeinfo unordered_map unordered_set utility
    valarray variant vector version cassert ccomplex cctype cerrno cfenv cfloat cinttypes ciso646 climits clocale cmath csetjmp csignal cstdalign cstdarg cstdbool cstddef cstdint cstdio cstdlib cstring
    ctgmath ctime cuchar cwchar cwctype""".split()
)
KOTLIN_STDLIB = {"kotlin", "kotlinx"}
SWIFT_MODULES = set(
    """Swift Foundation FoundationNetworking FoundationXML Combine Concurrency Observation SwiftUI UIKit AppKit CoreData CoreFoundation CoreGraphics CoreImage CoreLocation CoreServices CoreText CoreVideo CryptoKit
    GameKit MapKit Network Photos PhotosUI Security StoreKit WebKit XCTest SwiftData WidgetKit CloudKit AVFoundation CoreAudio CoreAnimation CoreMedia CoreMIDI Metal MetalKit MetalPerformanceShaders SceneKit
    SpriteKit Vision NaturalLanguage Speech CoreML CreateML ActivityKit BackgroundTasks UserNotifications OSLog System RegexBuilder Charts""".split()
)
CSHARP_STDLIB = {"System", "Microsoft"}
#: language: its catalog, and what separates the parts of a name of which a beginning is enough (empty: names are whole).
STANDARD = {
    "go": (GO_STDLIB, ""), "java": (JAVA_STDLIB, "."), "rust": (RUST_STDLIB, "::"), "php": (PHP_STDLIB, "\\"), "c": (C_HEADERS, ""), "cpp": (CPP_HEADERS, ""),
    "kotlin": (KOTLIN_STDLIB, "."), "swift": (SWIFT_MODULES, ""), "csharp": (CSHARP_STDLIB, "."),
}
