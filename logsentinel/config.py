"""Parameters of the operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of the detection tiers; times in milliseconds unless named otherwise."""

    window_ms: int = 60_000
    window_cap: int | None = None
    max_requests: int = 100
    max_failed_logins: int = 5
    failed_codes: tuple[int, ...] = (401, 403)
    least_chrome: int = 90
    least_firefox: int = 85
    max_agents: int = 3
    max_session_agents: int = 2
    session_gap_s: int = 1800
    session_failed_logins: int = 10
    session_requests: int = 30
    max_paths: int = 2000
    least_html: int = 5
    least_asset_ratio: float = 10.0
    z_threshold: float = 3.5
    min_samples: int = 30
    slow_factor: float = 3.0
    # fixed values: lists of the sample configuration
    bad_paths: tuple[str, ...] = ("../", "/etc/passwd", "sqlmap", "xss", "script")
    bad_agents: tuple[str, ...] = ("Nmap", "sqlmap", "nikto", "curl/")
    sensitive: tuple[str, ...] = ("admin", "config", "backup", ".env", "login", "wp-admin", "wp-login")
    headless: tuple[str, ...] = ("HeadlessChrome", "Puppeteer")
    known_bad: tuple[str, ...] = ("sqlmap", "Nmap")
    html_exact: tuple[str, ...] = ("/",)
    html_suffix: tuple[str, ...] = (".html", ".htm", ".php", ".jsp")
    asset_prefix: tuple[str, ...] = ("/static/", "/assets/", "/public/", "/media/", "/api/")
    asset_suffix: tuple[str, ...] = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff2", ".ico")
    desktop: tuple[str, ...] = ("Windows", "Macintosh", "Linux")
    mobile: tuple[str, ...] = ("iPhone", "Android")


#: For the sparse traffic of the test tables (about 66 requests of an address in 30 days).
SPARSE = Config(window_ms=86_400_000, max_requests=6, max_failed_logins=2, session_gap_s=21_600)
