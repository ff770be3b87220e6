"""Topic measurement over large social-text feeds, expressed as Spark plans."""
