"""cellgrid.operators"""
