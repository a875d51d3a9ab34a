"""geovis: PySpark jobs that measure how visible websites and brands are to conversational AI."""

from geovis.session import configure, get_session

__all__ = ["configure", "get_session"]
