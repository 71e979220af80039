"""Word lists, constants and formats that results depend on.

They are data, not logic.  Everything here must keep exactly these values for
"""

from __future__ import annotations

# --- path classification -----------------------------------------------------
EXCLUDED_PARTS = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "build",
    "dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages",
    "node_modules", ".tox",
]
TEST_PARTS = ["tests", "test", "spec", "specs"]
TEST_PREFIXES = ["test_", "spec_"]
TEST_SUFFIXES = ["_test.py", "_spec.py"]
UNMIRRORED_PART = ".git"
REQUIREMENTS_NAME = "requirements.txt"

# --- requirements ------------------------------------------------------------
REQUIRED_TOOLS = ["pytest", "codecarbon"]
INSTALLER_PREFIX = "pip "
COMMENT_MARK = "#"

# --- measurement logs --------------------------------------------------------
EMISSIONS_PREFIX = "EMISSIONS:"
EXIT_CODE_PREFIX = "EXIT_CODE:"
BENCHMARK_ARGUMENT = "97"

# --- model responses ---------------------------------------------------------
CODE_LINE_STARTS = ["import ", "from ", "def ", "class ", "#"]
TEST_OUTPUT_CHARS = 2000
DIAGNOSTIC_CHARS = 400

# --- status words ------------------------------------------------------------
STATUS_GENERATED = "generated"
STATUS_FAILED = "failed"
STATUS_PASSED_EXISTING = "passed_existing"
SKIP_NO_SPEC = "no_spec"
SKIP_NO_SOURCE = "source_file_not_found"
SKIP_BASELINE = "baseline_measurement_failed"
SKIP_TIMEOUT = "timeout"
ERROR_PREFIX = "error: "
RETRY_TESTS = "test suite failed"
RETRY_EMISSIONS_SUFFIX = "% worse emissions than baseline"
REPORT_STATUS = "optimised"

# --- attempt rule ------------------------------------------------------------
MAX_ATTEMPTS = 2
TIMEOUT_SECONDS = 17

# --- measured savings model --------------------------------------------------
CARBON_INTENSITY_KG_PER_KWH = 0.233
ELECTRICITY_USD_PER_KWH = 0.10
EU_ETS_USD_PER_TONNE = 65.0
VCM_USD_PER_TONNE = 15.0
ANNUAL_RUNS = 1000

# --- assumed savings model ---------------------------------------------------
ENERGY_PER_FUNCTION_KWH = 0.1
CO2_PER_KWH_KG = 0.364
ELECTRICITY_EUR_PER_KWH = 0.281
CAR_G_PER_KM = 120.0
PHONE_KG_PER_CHARGE = 0.005
STREAMING_KG_PER_HOUR = 0.036
TREE_KG_PER_YEAR = 21.0
DAYS_PER_YEAR = 365
