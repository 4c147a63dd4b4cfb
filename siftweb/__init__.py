"""siftweb: web-page audit, media inventory, URL risk and policy screening on Spark."""

__version__ = "0.1.0"
