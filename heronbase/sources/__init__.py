"""Where rows come from and go to: the catalog, its files, stages, bulk loads."""
