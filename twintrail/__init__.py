"""twintrail: clone-set and co-change analytics written as DataFrame plans."""
