"""Part of lumenark."""
