"""cellgrid.functions"""
