"""eventloom: governing, de-duplicating, delivering and maintaining wide JSON events on Spark."""
